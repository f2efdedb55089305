"""The block-max index against scores of all documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import lexical as L


def scored(docs, text):
    """BM25 of every document by the definition, and the number of the query's words that it has."""
    words = {}
    for i, t in docs:
        words.setdefault(i, []).extend((t or "").split())
    n, average = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = {}
    for i, w in words.items():
        tf, score, overlap = Counter(w), 0.0, 0
        for t, qf in Counter(text.split()).items():
            if tf[t]:
                score += qf * (idf[t] if idf[t] >= 0 else L.EPSILON * mean) * tf[t] * (L.K1 + 1) / (tf[t] + L.K1 * (1 - L.B + L.B * len(w) / average))
                overlap += 1
        out[i] = (round(score, 9), overlap)
    return out


def expected(docs, queries, k, by):
    out = set()
    for q, text in queries:
        if not (text or "").split():
            continue
        ranked = sorted((-v[by == "overlap"], i, v) for i, v in scored(docs, text).items() if by == "score" or v[1])
        out |= {(q, i, r + 1, *v) for r, (_, i, v) in enumerate(ranked[:k])}
    return out


def found(df):
    return {(r.query_id, r.doc_id, r.rank, round(r.score, 9), r.overlap) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    some = lambda n, common: " ".join(rng.choice(words[:20] if rng.random() < common else words) for _ in range(n))
    docs = [(5 * k, some(rng.randint(1, 60), 0.5)) for k in range(400)] + [(3, None), (4, ""), (10, "w7 w7"), (1000, some(30, 0.2)), (2500, "common " * 9), (2600, "rare")]
    docs += [(3000 + k, "always") for k in range(250)]
    queries = [(k, some(rng.randint(1, 8), 0.3)) for k in range(12)] + [(20, "rare"), (21, "nowhere"), (22, ""), (23, None), (24, "always"), (25, "common always w0 w0")]
    return docs, queries


@pytest.mark.parametrize("range_docs", [16, 4096])
def test_against_all_scores(spark, corpus, monkeypatch, range_docs):
    monkeypatch.setattr(L, "FEW_RANGES", 0)
    monkeypatch.setattr(L, "QUERY_PART", 4)
    docs, queries = corpus
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(queries, "query_id bigint, text string")
    index = L.index_of(df, range_docs)
    by_score, by_overlap = L.search(index, L.weights(index, asked), 5, ("score", "overlap"))
    assert found(by_score) == expected(docs, queries, 5, "score")
    assert found(by_overlap) == expected(docs, queries, 5, "overlap")


def test_ranges_below_the_threshold_are_not_read(spark, corpus, monkeypatch):
    docs = corpus[0] + [(900 + k, "alpha beta w0") for k in (1, 2, 3)]
    query = "alpha beta w0 w1 w2"
    monkeypatch.setattr(L, "FEW_RANGES", 0)
    read, real = [], L._read
    monkeypatch.setattr(L, "_read", lambda index, asked, pairs, k, orders: read.append(pairs.count()) or real(index, asked, pairs, k, orders))
    index = L.index_of(spark.createDataFrame(docs, "doc_id bigint, text string"), 16)
    asked = spark.createDataFrame([(1, query)], "query_id bigint, text string")
    held = index.heads.join(L.weights(index, asked), "term").select("range").distinct().count()
    (hits,) = L.search(index, L.weights(index, asked), 3)
    assert found(hits) == expected(docs, [(1, query)], 3, "score")
    assert sum(read) <= 2 and held > 20


def test_a_range_holds_its_documents_once(spark, corpus):
    docs, _ = corpus
    index = L.index_of(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 32)
    heads = sorted((r.range, r.low, r.n) for r in index.heads.where("term = ''").collect())
    assert sum(n for _, _, n in heads) == len({i for i, _ in docs})
    assert [low for _, low, _ in heads] == sorted(low for _, low, _ in heads)
    ids = [i for r in sorted(index.blocks.where("term = ''").collect(), key=lambda r: r.range) for i in r.docs]
    assert ids == sorted({i for i, _ in docs})


def test_few_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert L.bm25(none, asked, 3).collect() == []
    one = spark.createDataFrame([(7, "a b"), (None, "a")], "doc_id bigint, text string")
    assert [(r.query_id, r.doc_id, r.rank) for r in L.bm25(one, asked, 3).collect()] == [(1, 7, 1)]
    assert L.bm25(one, asked.limit(0), 3).collect() == []


@pytest.mark.parametrize(("room", "many"), [(1_000_000, 1_000_000), (40, 0)])
def test_scan_against_all_scores(spark, corpus, monkeypatch, room, many):
    monkeypatch.setattr(L, "SCAN_WORDS", room)
    monkeypatch.setattr(L, "MANY_DOCS", many)
    monkeypatch.setattr(L, "SCAN_DOCS", 37)
    docs, queries = corpus
    docs = docs + [(None, "w1 w2")]
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(queries, "query_id bigint, text string")
    assert found(L.scanned(df, asked, 5)) == expected(docs[:-1], queries, 5, "score")
    named = L.scanned(df.where("doc_id <> 10").select(F.format_string("d%05d", "doc_id").alias("doc_id"), "text"), asked, 5)
    assert {(q, int(d[1:]), *rest) for q, d, *rest in found(named)} == expected([x for x in docs[:-1] if x[0] != 10], queries, 5, "score")


def test_many_queries_write_no_pairs_with_ranges(spark, monkeypatch):
    """Rows written for very many queries grow with documents and with queries, not with their product."""
    rng, rows, real = random.Random(5), {}, L.stored
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    docs, queries = [(k, text(5)) for k in range(60_000)], [(k, text(25)) for k in range(1000)]

    def counted(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(L, "stored", counted)
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(queries, "query_id bigint, text string")
    hits = L.bm25(df, asked, 2)
    assert hits.count() == 2000
    assert rows.pop("words", 0) <= 60_000 and max(rows.values()) <= 30_000


def test_scan_of_few_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "???")], "query_id bigint, text string")
    assert L.scanned(none, asked, 3).collect() == []
    one = spark.createDataFrame([(7, "a b"), (None, "a")], "doc_id bigint, text string")
    assert [(r.query_id, r.doc_id, r.rank) for r in L.scanned(one, asked, 3).collect()] == [(1, 7, 1)]
    assert L.scanned(one, asked.limit(0), 3).collect() == []


def test_hybrid_stages_search_vectors_once(spark, monkeypatch):
    """The four stages share one dense list, and reranking leaves the texts of documents where they are."""
    from lexquarry.plans import retrieval

    calls, real = [], retrieval.S.dense
    monkeypatch.setattr(retrieval.S, "dense", lambda *a, **b: calls.append(1) or real(*a, **b))
    assert retrieval.four_stage_metrics(spark, "/root/testdata/sf0.001").count() == 4
    assert len(calls) == 1
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(3)
    monkeypatch.setattr(retrieval.S, "stored", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = retrieval.S.rerank(docs.select(F.lit(1).alias("query_id"), "doc_id", F.lit(1).alias("rank")), docs, spark.createDataFrame([(1, "a")], "query_id int, text string"))
        assert "BroadcastHashJoin [doc_id" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
