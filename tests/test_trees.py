"""Document trees as a data source."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.sources import trees as T


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_round_trip(pushed, tmp_path):
    rows = [(f"c{k % 3}", f"d{k}", json.dumps({"pages": [k], "text": "ü\n"})) for k in range(20)]
    path = str(tmp_path / "tree")
    T.write_tree(pushed.createDataFrame(rows, "category string, document string, value string").repartition(5), path)
    (tmp_path / "tree" / "c0" / "d0" / "other_structured.json").write_text("{}")
    (tmp_path / "tree" / ".hidden").mkdir()
    read = T.read_tree(pushed, path)
    assert sorted((r.category, r.document, r.value) for r in read.collect()) == sorted(rows)
    some = read.where(F.col("category").isin("c1", "none") & (F.length("value") > 0)).where("document = 'd4'")
    assert [(r.category, r.document) for r in some.collect()] == [("c1", "d4")]
    # the plan keeps only the filter that the source can't take over
    assert "length(value" in plan(some) and "(category" not in plan(some) and "(document#" not in plan(some)
    assert [r.document for r in T.read_tree(pushed, path, only={"document": ["d4", "d9"], "category": ["c1"]}).collect()] == ["d4"]
    assert read.where("category = '../tree'").collect() == [] and sorted(p.name for p in (tmp_path / "tree").iterdir()) == [".hidden", "c0", "c1", "c2"]


def test_excluded_folders_are_not_listed(tmp_path):
    for c in ("a", "b"):
        (tmp_path / c / "x").mkdir(parents=True)
        (tmp_path / c / "x" / "x_structured.json").write_text("{}")
    reader = T.PushedReader(str(tmp_path), "documents", 1)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([EqualTo(("category",), "b"), left, In(("document",), ("x", "y"))])) == [left]
    (tmp_path / "a").chmod(0)
    assert [p.pieces[0].category for p in reader.partitions()] == ["b"]
    (tmp_path / "a").chmod(0o755)


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<f2", "<i2"])
def test_rows_of_a_matrix(order, dtype):
    x = np.asarray(np.arange(60).reshape(12, 5), dtype=dtype, order=order)
    file = io.BytesIO()
    np.save(file, x)
    file.seek(0)
    h = T.npy_header(file)
    assert (h.rows, h.width, h.by_columns) == (12, 5, order == "F")
    assert (T.npy_rows(file, h, 3, 4) == x[3:7]).all()


def test_headers_that_are_no_matrix():
    for x in (np.zeros(3), np.zeros((2, 2), complex)):
        file = io.BytesIO()
        np.save(file, x)
        file.seek(0)
        with pytest.raises(ValueError, match="matrix"):
            T.npy_header(file)
    with pytest.raises(ValueError, match="npy"):
        T.npy_header(io.BytesIO(b"something else"))


def test_vectors_round_trip(spark, tmp_path):
    rows = [(f"c{k % 2}", f"d{k % 7}", k, [float(k), -k / 8], {"id": str(k), "note": "ü"} if k % 5 else {}) for k in range(100)]
    path = str(tmp_path / "tree")
    T.write_tree(spark.createDataFrame(rows, "category string, document string, position bigint, embedding array<float>, metadata map<string,string>").repartition(4), path, "vectors")
    expected = sorted((c, d, v, m) for c, d, _, v, m in rows)
    for size in (T.PARTITION_BYTES, 24):  # the smaller size cuts every file into pieces of three rows
        read = T.read_tree(spark, path, "vectors", size)
        assert sorted((r.category, r.document, r.embedding, r.metadata) for r in read.collect()) == expected
        assert read.rdd.getNumPartitions() > 30 or size > 24
    x = np.load(f"{path}/c1/d3/d3.npy")
    assert x.tolist() == [v for c, d, _, v, _ in rows if (c, d) == ("c1", "d3")]


def test_matrices_without_or_with_short_lists(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "c" / name).mkdir(parents=True)
        np.save(tmp_path / "c" / name / f"{name}.npy", np.eye(3))
    (tmp_path / "c" / "b" / "b.json").write_text(json.dumps([{"chunk_id": 7, "tags": ["x"]}, {}]))
    got = sorted((r.document, r.position, r.metadata) for r in T.read_tree(spark, str(tmp_path), "vectors").collect())
    assert got == [("b", 0, {"chunk_id": "7", "tags": '["x"]'}), ("b", 1, {}), ("b", 2, None)]


def test_names_that_are_no_folder(spark, tmp_path):
    for name in (None, "a/b", ""):
        with pytest.raises(Exception, match="folder"):
            T.write_tree(spark.createDataFrame([("c", name, "{}")], "category string, document string, value string"), str(tmp_path))
    with pytest.raises(Exception, match="kind"):
        T.read_tree(spark, str(tmp_path), "other").schema
    (tmp_path / "empty").mkdir()
    assert T.read_tree(spark, str(tmp_path / "empty")).collect() == []
