"""Classes, repeated tables, cohorts, inventories and comparisons on small tables."""

import random

from pyspark.sql import functions as F

from lexquarry.operators import classes as G
from lexquarry.operators import cleaning as C
from lexquarry.operators import search as S
from lexquarry.sources import tables as R


def test_classes_of_links(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, k) for k in range(501, 540)] + [(7, 8), (8, 7), (9, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {(r.node, r.class_id, r.n_links) for r in G.classes(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {(x, find(x), len(n)) for x, n in near.items()}
    assert G.classes(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_tables_that_come_again(spark):
    rows = [
        (5, ["A", "b"], [["1", "2"], ["3", "4"]]),
        (2, ["a ", "B"], [["3", " 4"], ["1", "2"]]),  # other order, case and white space
        (3, ["b", "a"], [["1", "2"], ["3", "4"]]),
        (4, ["a", "b"], [["1", "2"], ["3", "4"], ["3", "4"]]),
        (6, ["a", "b"], [["1", "23"], ["4", ""]]),
        (7, None, None),
        (8, [], [[" ", None]]),
        (9, None, [[None, "x"], None]),
        (10, [], [["", "X"], []]),
    ]
    got = sorted(map(tuple, G.repeated_tables(spark.createDataFrame(rows, "table_id int, headers array<string>, rows array<array<string>>")).collect()))
    assert got == [(2, 2, 2), (5, 2, 2), (9, 9, 2), (10, 9, 2)]


def test_cohorts(spark):
    schema = "document_id string, n_pages int, n_headers int, n_footers int, n_joined int, n_warnings int, n_transforms int, original_chars bigint, cleaned_chars bigint, pct_change double"
    docs = [("a", 1, 1, 0, 2, 0, 3, 100, 90, -10.0), ("b", 2, 0, 1, 0, 1, 0, 100, 110, 10.0), ("c", 1, 0, 0, 0, 0, 0, 0, 0, 0.0)]
    got = {r.cohort: r for r in C.cohorts(spark.createDataFrame(docs, schema), spark.createDataFrame([("a", "x"), ("b", "x"), ("z", "y")], "document_id string, cohort string")).collect()}
    assert set(got) == {"x", "none"}
    assert (got["x"].n_documents, got["x"].n_pages, got["x"].n_grown, got["x"].most_changed, got["x"].pct_change) == (2, 3, 1, "a", 0.0)
    assert got["none"].pct_change == 0.0


def test_inventory_from_manifests(spark):
    manifests = [("f", '{"documents": {"d1": {"category": "law", "expected_pages": 3, "duplicate_of": ["d9"]}, "d2": {"actual_pages": 4}, "p1": {}}}'), ("g", '{"documents": {'), ("h", "{}"), ("i", None)]
    scanned = [("f", "d7", "law", 9, 9), ("g", "d3", "art", None, 5), ("g", "p1", "art", 1, 1), ("h", "d4", None, 2, 6), ("k", "d5", "art", 1, 7)]
    found = R.manifest_inventory(spark.createDataFrame(manifests, "folder string, value string"), spark.createDataFrame(scanned, "folder string, document_id string, category string, n_pages int, size int"), spark.createDataFrame([("p1",)], "document_id string"))
    got = {r.document_id: (r.folder, r.category, r.relative_path, r.expected_pages, r.duplicate_of, r.from_manifest) for r in found.collect()}
    assert got == {
        "d1": ("f", "law", "documents/d1.pdf", 3, ["d9"], True),
        "d2": ("f", "root", "documents/d2.pdf", 4, [], True),
        "d3": ("g", "art", "documents/d3.pdf", 0, [], False),
        "d4": ("h", None, "documents/d4.pdf", 2, [], False),
        "d5": ("k", "art", "documents/d5.pdf", 1, [], False),
    }


def test_stages_beside_a_base(spark):
    figures = spark.createDataFrame([("v", 50.0, 0.25), ("h", 75.0, 0.5)], "stage string, hit5 double, mrr double")
    got = {r.stage: (r.hit5_gain, r.mrr_gain, r.best) for r in S.compared(figures, "v").collect()}
    assert got == {"v": (0.0, 0.0, False), "h": (25.0, 0.25, True)}
    assert {(r.hit5_gain, r.best) for r in S.compared(figures, "none").collect()} == {(None, False), (None, True)}


def test_weights_of_two_scores(spark):
    rows = [(1, 10, 0.9, 0.0), (1, 11, 0.5, 1.0), (1, 12, 0.7, 0.5)]
    found = S.weighted(spark.createDataFrame(rows, "query_id int, doc_id int, vector double, reranker double").withColumn("rank", F.lit(1)), "vector", "reranker", (0.8, 0.2), 2)
    assert [(r.doc_id, round(r.hybrid, 6)) for r in found.orderBy("rank").collect()] == [(10, 0.8), (12, 0.5)]
