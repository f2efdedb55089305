"""The checkpoint machine as a stream."""

import datetime as dt

from lexquarry.streaming.ingest import checkpoints

SCHEMA = "key bigint, status string, at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_stale_documents_are_taken_up_again(spark, tmp_path):
    source, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")

    def batch(*events):
        """One run of the stream over new events, from the state of the runs before; the rows that it adds."""
        spark.createDataFrame([(k, s, at(m)) for k, s, m in events], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        before = spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0
        query = checkpoints(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = sorted((r.key, r.at.minute + 60 * r.at.hour, r.status, r.n_attempts) for r in spark.read.parquet(out).collect())
        assert len(rows) >= before
        return rows

    first = batch((1, "IN_PROGRESS", 0), (2, "IN_PROGRESS", 0), (2, "SUCCESS", 5), (3, "IN_PROGRESS", 1), (3, "FAILED", 2))
    assert first == [(1, 0, "IN_PROGRESS", 1), (2, 0, "IN_PROGRESS", 1), (2, 5, "SUCCESS", 1), (3, 1, "IN_PROGRESS", 1), (3, 2, "PENDING", 1)]
    # a restart; time goes on, so the first document is stale; the second has ended for good, and the third fails for the last time
    second = batch((9, "IN_PROGRESS", 50), (2, "IN_PROGRESS", 51), (3, "IN_PROGRESS", 52), (3, "FAILED", 53), (3, "IN_PROGRESS", 54), (3, "FAILED", 55))
    assert [r for r in second if r[0] == 1] == [(1, 0, "IN_PROGRESS", 1), (1, 30, "PENDING", 1)]
    assert [r for r in second if r[0] == 2] == [(2, 0, "IN_PROGRESS", 1), (2, 5, "SUCCESS", 1)]
    assert [r for r in second if r[0] == 3][-3:] == [(3, 53, "PENDING", 2), (3, 54, "IN_PROGRESS", 3), (3, 55, "FAILED", 3)]
    # a worker takes the first one up, and an event that came late is passed over
    third = batch((1, "IN_PROGRESS", 60), (1, "SUCCESS", 61), (3, "SUCCESS", 40))
    assert [r for r in third if r[0] == 1][-2:] == [(1, 60, "IN_PROGRESS", 2), (1, 61, "SUCCESS", 2)]
    assert [r for r in third if r[0] == 3][-1] == (3, 55, "FAILED", 3)
