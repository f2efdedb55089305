"""A keyed collection against a dictionary."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from lexquarry.sources.collection import BASE, Collection
from lexquarry.sources.store import Marks

ROW = "point_id bigint, embedding array<double>, note string"


def rows(spark, some):
    return spark.createDataFrame([(k, [float(v)], f"n{v}") for k, v in some], ROW)


def held(df):
    found = [(r.point_id, int(r.note[1:])) for r in df.collect()]
    assert len(found) == len({k for k, _ in found})
    return dict(found)


def test_upserts_deletes_and_compaction(spark, tmp_path):
    c, expected, rng = Collection(spark, str(tmp_path), part_rows=20), {}, random.Random(2)
    assert c.read() is None and c.verify()["rows"] == 0 and not c.compact("c0")
    for step in range(7):
        if step == 3:
            gone = [(rng.randrange(120),) for _ in range(15)] + [(None,)]
            assert c.delete(spark.createDataFrame(gone, "point_id bigint"), f"b{step}")
            expected = {k: v for k, v in expected.items() if (k,) not in gone}
        elif step == 4:
            before = c.parts()
            assert c.compact("c1") and not c.compact("c1")
            assert {p.kind for p in c.parts()} == {BASE} and c.parts() != before
        else:
            new = {(rng.randrange(120) if step < 3 else rng.randrange(10)): 100 * step + k for k in range(30)}
            assert c.upsert(rows(spark, new.items()), f"b{step}")
            expected |= new
        assert held(c.read()) == expected
        assert held(c.read(10, 40)) == {k: v for k, v in expected.items() if 10 <= k <= 40}
    assert not c.upsert(rows(spark, [(1, 999)]), "b6") and held(c.read()) == expected
    assert c.verify() == {"rows": len(expected), "without_vector": 0, "lengths": 1, "parts": len(c.parts()), "late_parts": 2}
    assert c.compact("c2") and held(c.read()) == expected
    assert c.vacuum() > 0 and c.vacuum() == 0 and held(c.read()) == expected


def test_untouched_parts_are_read_as_they_are(spark, tmp_path):
    c = Collection(spark, str(tmp_path), part_rows=10)
    c.upsert(rows(spark, [(k, k) for k in range(100)]), "a")
    c.compact("b")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(c.read()) and len(c.parts()) >= 8
    c.upsert(rows(spark, [(41, 1), (43, 2)]), "d")
    before = {(p.run, p.part) for p in c.parts()}
    assert len(c.read().inputFiles()) >= 8 and "Window" not in plan(c.read())
    assert held(c.read()) == {**{k: k for k in range(100)}, 41: 1, 43: 2}
    assert "Exchange" not in plan(c.read(60, 70)) and held(c.read(60, 61)) == {60: 60, 61: 61}
    assert before == {(p.run, p.part) for p in c.parts()}


def test_new_columns_and_repeated_keys(spark, tmp_path):
    c = Collection(spark, str(tmp_path))
    c.upsert(spark.createDataFrame([("a", [1.0]), ("a", [1.0]), (None, [2.0])], "point_id string, embedding array<double>"), "1")
    c.compact("2")
    c.upsert(spark.createDataFrame([("b", None, 5)], "point_id string, embedding array<double>, extra int"), "3")
    assert sorted((r.point_id, r.embedding, r.extra) for r in c.read().collect()) == [("a", [1.0], None), ("b", None, 5)]
    assert c.verify()["without_vector"] == 1
    c.delete(spark.createDataFrame([("a",), ("b",), ("z",)], "point_id string"), "4")
    assert c.read().collect() == []
    assert c.compact("5") and c.parts() == [] and c.read() is None


def test_a_batch_of_several_writers_counts_once(spark, tmp_path):
    marks = Marks(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: marks.make("one", str(k)), range(16)))
    assert made.count(True) == 1 and marks.read()["one"] == str(made.index(True))
    for name in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError, match="name"):
            marks.make(name, "")
