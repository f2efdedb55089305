"""Streams: documents to chunks, live conversation memory, windowed event counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexquarry.operators import chunking as K
from lexquarry.operators import cleaning as C
from lexquarry.operators.context import HISTORY


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text): repaired, normalised, segmented and packed."""
    clean = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), C.repaired(C.line_feeds(F.col("text")))["text"].alias("text"))
    pages = clean.withColumn("text", C.normalised(F.col("text"))["text"])
    return K.chunks(K.groups(K.segments(pages)))


def ingest(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Chunks every batch of a stream of documents into a folder of its own below sink.

    A batch that is run again after a failure overwrites its folder, so nothing is counted twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        chunked(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The chunks of each document's last batch."""
    every = spark.read.schema(K.CHUNKS + ", batch int").parquet(sink)
    last = every.withColumn("last", F.max("batch").over(Window.partitionBy("document_id")))
    return last.where("batch = last").drop("last", "batch")


def live_memory(exchanges: DataFrame, last: int = HISTORY) -> DataFrame:
    """conv_id, turn, n_history, history of a stream of exchanges (conv_id, turn, question, answer): the state holds the last ones."""

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            out.append((key[0], r.turn, len(held), "\n".join(held)))
            if r.answer is not None:
                held = [*held, f"{r.question}\n{r.answer}"][-last:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_history", "history"])

    return exchanges.groupBy("conv_id").applyInPandasWithState(remember, "conv_id bigint, turn bigint, n_history int, history string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, repeated ids counted once; rows later than the watermark are left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


#: Attempts of a document before it has failed for good.
ATTEMPTS = 3


def checkpoints(events: DataFrame, stale: str = "30 minutes", attempts: int = ATTEMPTS) -> DataFrame:
    """key, status, at, n_attempts of a stream of status events (key, status, at): a row for each change of a key's status.

    A key that is IN_PROGRESS and hears nothing for the time stale, by the watermark of events, is PENDING again, so that a crashed worker's documents are
    taken up; each start counts as an attempt, and one that goes stale or fails after the last attempt is FAILED. SUCCESS is final. Events of a key
    count in order of time within a batch, older ones than its last are passed over.
    """
    wait = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at, n = state.get if state.exists else ("PENDING", 0, 0)
        out = []

        def change(new: str, when: int) -> None:
            nonlocal status, at
            new = "FAILED" if new == "PENDING" and n >= attempts else new
            if new != status:
                out.append((key[0], new, pd.Timestamp(when, unit="ms"), n))
            status, at = new, when

        if state.hasTimedOut:
            if status == "IN_PROGRESS":
                change("PENDING", at + wait)
        else:
            for r in pd.concat(list(frames)).sort_values(["at", "status"]).itertuples():
                when = int(r.at.timestamp() * 1000)
                if status == "SUCCESS" or when < at:
                    continue
                if status == "IN_PROGRESS" and when > at + wait:
                    change("PENDING", at + wait)
                if r.status == "IN_PROGRESS" and status != "FAILED":
                    n += 1
                    change("IN_PROGRESS", when)
                elif r.status == "FAILED":
                    change("PENDING" if n < attempts else "FAILED", when)
                elif r.status == "SUCCESS":
                    change("SUCCESS", when)
        state.update((status, at, n))
        if status == "IN_PROGRESS":
            state.setTimeoutTimestamp(max(at + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "status", "at", "n_attempts"])

    kept = events.select("key", "status", "at").withWatermark("at", "0 seconds")
    return kept.groupBy("key").applyInPandasWithState(step, "key bigint, status string, at timestamp, n_attempts int", "status string, at bigint, n int", "append", GroupStateTimeout.EventTimeTimeout)
