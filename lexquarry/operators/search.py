"""Lexical and dense retrieval, fusion, reranking and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators.lexical import DEPTH, Index, bm25, index_of, postings, search, small, term_stats, tokens, top, weights
from lexquarry.sources.store import stored

__all__ = ["DEPTH", "Index", "bm25", "index_of", "postings", "search", "small", "term_stats", "tokens", "top", "weights"]  # lexical search

#: Fusion constant, depth of a final list.
RRF_K, FINAL = 60, 5
#: Rows of a block of vectors and of one of query vectors that are shuffled together, and those of their parts that make one product.
VECTOR_BLOCK, QUERY_BLOCK, VECTOR_PART, QUERY_PART = 20_000, 2_000, 2_048, 256


def _units(table: pa.Table, key: str, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table's rows, read from Arrow's buffers; null vectors are left out."""
    table = table.combine_chunks().filter(pc.is_valid(table.column("embedding")))
    ids = table.column(key).to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 1), np.float32)
    lists = table.column("embedding").combine_chunks()
    return ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[:, :dims]


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; zero vectors become NaN, which nothing is near."""
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, np.nan)


def _nearest(ids: np.ndarray, y: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of each query's k nearest vectors, ties by vector; only parts of both sides are multiplied at once."""
    out = []
    for i in range(0, len(ids), QUERY_PART):
        asked, unit = ids[i : i + QUERY_PART], _unit(y[i : i + QUERY_PART])
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(vec), VECTOR_PART):
            near = np.round(unit @ _unit(x[j : j + VECTOR_PART]).T, 9)
            near[(asked[:, None] == vec[None, j : j + VECTOR_PART]) | ~np.isfinite(near)] = -np.inf
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k] if near.shape[1] > k else np.full((len(asked), 1), -np.inf)
            r, c = np.nonzero((near >= least) & (near > -np.inf))
            row, at, score = np.concatenate([row, r]), np.concatenate([at, c + j]), np.concatenate([score, near[r, c]])
            order = np.lexsort((vec[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(row)]
            keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
            row, at, score = row[keep], at[keep], score[keep]
        out.append((asked[row], vec[at], score))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], vec[:0], np.zeros(0))


def dense(vectors: DataFrame, queries: DataFrame, k: int = DEPTH, dims: int | None = None) -> DataFrame:
    """query_id, vec_id, score (cosine), rank: the k nearest vectors of each query vector, without itself.

    vectors (vec_id, embedding), queries (query_id, embedding), embeddings of one length. Both sides are cut into blocks of bounded
    size, and each pair of blocks gives k vectors for each query. Null and zero vectors are near nothing.
    """
    many_v, many_q = (max(1, -(-df.count() // rows)) for df, rows in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, times: int) -> DataFrame:
        return df.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        query, vec, score = _nearest(*_units(q, "query_id", dims), *_units(v, "vec_id", dims), k)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    left = dealt(vectors, "vec_id", "v", many_v, "q", many_q).groupBy("v", "q")
    right = dealt(queries, "query_id", "q", many_q, "v", many_v).groupBy("v", "q")
    found = left.cogroup(right).applyInArrow(best, "query_id bigint, vec_id bigint, score double")
    return top(found, [F.col("score").desc(), F.col("vec_id")], k)


def fuse(lists: list[DataFrame], k: int = DEPTH) -> DataFrame:
    """query_id, doc_id, score, rank: reciprocal rank fusion of ranked lists (query_id, doc_id, rank).

    Ties keep the order of first appearance: by list, then by rank in it.
    """
    each = [x.select("query_id", "doc_id", F.lit(i).alias("list"), F.col("rank").alias("at")) for i, x in enumerate(lists)]
    all_ = each[0]
    for x in each[1:]:
        all_ = all_.union(x)
    fused = all_.groupBy("query_id", "doc_id").agg(F.sum(1 / (RRF_K + F.col("at"))).alias("score"), F.min(F.struct("list", "at")).alias("first"))
    return top(fused, [F.round("score", 12).desc(), F.col("first")], k).drop("first")


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, depth: int = DEPTH, k: int = DEPTH, lexical: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the dense and the BM25 list of depth documents each, dense first, fused.

    vectors (vec_id, embedding) and docs (doc_id, text) share ids; a BM25 list and a dense one (query_id, doc_id, rank) that are there already may be given.
    """
    near = dense(vectors, query_vectors, depth).withColumnRenamed("vec_id", "doc_id") if near is None else near
    return fuse([near, bm25(docs, queries, depth) if lexical is None else lexical], k)


def normalised(vector: Column) -> Column:
    """A vector of length one; null and zero vectors stay as they are."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def encoded(texts: DataFrame, encode: Callable[[], Callable[[list[str]], Any]], text: str = "text", batch: int = 64) -> DataFrame:
    """texts with embedding: unit vectors of a model that encode loads once a task; batch texts are encoded at a time.

    The model maps a list of texts to a matrix. Null texts are encoded as empty. Rows that are done already are left out by
    joining them away first (state.pending), which makes a run resumable.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encode()
        for b in batches:
            rows = [np.asarray(model([t or "" for t in b.slice(i, batch).to_pylist()]), np.float64) for i in range(0, len(b), batch)]
            yield pa.array([v.tolist() for r in rows for v in r], pa.list_(pa.float64()))

    return texts.withColumn("embedding", run(F.col(text))).withColumn("embedding", normalised(F.col("embedding")))


def deduplicated(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the content of its last row by order, at the place of its first, as column order."""
    rest = [c for c in chunks.columns if c not in (key, order)]
    last = chunks.groupBy(key).agg(F.min(order).alias(order), F.max(F.struct(order, *rest)).alias("__last"))
    return last.select(key, order, *[F.col("__last")[c].alias(c) for c in rest])


def min_max(column: str, key: str = "query_id") -> Column:
    """A score between the least and the greatest of its query; 1 where all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low))


def weighted(candidates: DataFrame, first: str, second: str, weights: tuple[float, float] = (0.4, 0.6), k: int = FINAL) -> DataFrame:
    """The k best by a weighted sum of two normalised scores, as column hybrid."""
    scaled = candidates.withColumn("__a", min_max(first)).withColumn("__b", min_max(second))
    scaled = scaled.withColumn("hybrid", weights[0] * F.col("__a") + weights[1] * F.col("__b")).drop("__a", "__b", "rank")
    return top(scaled, [F.round("hybrid", 9).desc(), F.col("doc_id")], k)


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int = FINAL) -> DataFrame:
    """query_id, doc_id, score, rank: candidates by the share of the query's terms that the document has.

    This stands in for a pair-scoring model; ties keep the candidates' order. Few candidates go to the texts, which are not shuffled then.
    """
    candidates = small(stored(candidates.select("query_id", "doc_id", "rank"), "candidates"))
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    read = docs.select("doc_id", "text").join(candidates, "doc_id").join(asked, "query_id")
    read = read.select("query_id", "doc_id", "rank", "asked", tokens(F.col("text")).alias("words"))
    scored = read.select("query_id", "doc_id", (F.size(F.array_intersect("asked", "words")) / F.size("asked")).alias("score"), F.col("rank").alias("before"))
    return top(scored, [F.round("score", 9).desc(), F.col("before")], k).drop("before")


def metrics(hits: DataFrame, queries: DataFrame, by: list[str], depth: int = FINAL) -> DataFrame:
    """Ranking metrics by stage columns: hits (by, query_id, rank, relevant) against all queries (query_id).

    Queries without hits count as zeros. Hits and precision are percentages; precision both over the hits returned
    and over depth.
    """
    at = lambda k: F.max(F.when(F.col("relevant") & (F.col("rank") <= k), 1.0).otherwise(0.0))
    inside = F.col("rank") <= depth
    found = F.sum(F.when(F.col("relevant") & inside, 1.0).otherwise(0.0))
    figures = ("hit1", "hit3", "hit5", "precision_returned", "precision_fixed", "mrr")
    each = hits.groupBy(*by, "query_id").agg(at(1).alias("hit1"), at(3).alias("hit3"), at(5).alias("hit5"), F.coalesce(found / F.nullif(F.count_if(inside), F.lit(0)), F.lit(0.0)).alias("precision_returned"), (found / depth).alias("precision_fixed"), F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("mrr"))
    # Sums over the queries with hits, divided by the number of all; one row is joined.
    sums = each.groupBy(*by).agg(*[F.sum(c).alias(c) for c in figures]).crossJoin(F.broadcast(queries.agg(F.count("*").alias("n_queries"))))
    scaled = [(F.col(c) / F.col("n_queries") * (1 if c == "mrr" else 100)).alias(c) for c in figures]
    return sums.select(*by, "n_queries", *scaled).withColumn("quality", (F.col("hit5") + 100 * F.col("mrr")) / 2)


def compared(figures: DataFrame, base: str) -> DataFrame:
    """metrics() by stage with hit5_gain and mrr_gain over the stage named base, and best: whether no stage has a greater mean reciprocal rank."""
    of_base = F.broadcast(figures.where(F.col("stage") == base).select(F.col("hit5").alias("__hit5"), F.col("mrr").alias("__mrr")))  # one row
    most = F.broadcast(figures.agg(F.max(F.round("mrr", 9)).alias("__most")))  # one row
    joined = figures.crossJoin(most).join(of_base, F.lit(True), "left")
    return joined.withColumns({"hit5_gain": F.col("hit5") - F.col("__hit5"), "mrr_gain": F.col("mrr") - F.col("__mrr"), "best": F.round("mrr", 9) == F.col("__most")}).drop("__hit5", "__mrr", "__most")
