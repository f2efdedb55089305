"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors of length one are projected on Gaussian directions, shifted and cut into cells of fixed width; several
such cells together are a bucket key, and there are several independent tables of keys. Vectors that meet in
a bucket are compared by their cosine. Equal vectors are one class with a count; the pairs of a bucket are
counted in blocks and never written out, each pair in the first table in which it meets.

Projections are sums of products of whole numbers, exact in double precision, so that a vector falls into the same cells
whatever other vectors it is projected with.

At the cosine bound of 0.93 two vectors of length one are 0.374 apart: with cells of width 2.2 a projection
agrees with probability 0.86, ten agree with 0.23, and one of 24 tables has them together with 0.998; closer
pairs are found more surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm import common as C

#: Vectors of one bucket that are compared in one block, bucket rows of one group of buckets, rows of a block compared at once, and
#: vectors up to which buckets are compared all together.
BLOCK, GROUP_ROWS, STRIP, FEW = 2000, 4000, 128, 24


@dataclass(frozen=True)
class Hashing:
    """Parameters of the tables; cosine is the bound from which on vectors link."""

    cosine: float = 0.93
    tables: int = 24
    cells: int = 10
    width: float = 2.2
    seed: int = 20

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket keys (vector, table) of vectors of length one."""
        dims = unit.shape[1]
        rng = np.random.default_rng([self.seed, dims])
        # Whole numbers: a sum of products is at most 2**24 * 2**fine * the direction's length, under 2**53 for any dims.
        fine = min(20, 26 - math.ceil(math.log2(dims) / 2))
        directions = np.rint(rng.standard_normal((dims, self.tables * self.cells)) * 2**fine)
        shift = rng.uniform(0, self.width, self.tables * self.cells)
        projected = (np.rint(unit * 2**24) @ directions) / 2.0 ** (24 + fine)
        cell = np.floor((projected + shift) / self.width).astype(np.int64).view(np.uint64).reshape(-1, self.tables, self.cells)
        key = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(dims), cell.shape[:2]).copy()
        for k in range(self.cells):
            key = C.mixed(key * np.uint64(C.BASE) + cell[:, :, k])
        return key


def _unit(binary: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors of length one) by dimension."""
    raw = [np.frombuffer(x.as_buffer(), kind) for x in binary]
    sizes = np.array([len(x) for x in raw])
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = np.stack([raw[r] for r in rows]).astype(np.float64)
        # The largest component is one first: squares of tiny or huge ones would not be finite.
        x /= np.abs(x).max(1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _vectors(embeddings: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, vec (binary; null if the vector can't link)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            values = lists.flatten()
            bad = ~np.isfinite(values.fill_null(float("nan")).to_numpy(zero_copy_only=False))
            values = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(np.r_[0, [len(x) if x.is_valid else 0 for x in lists]])
            labels = b.column("label").is_valid().to_numpy(zero_copy_only=False)
            out = [values[i:j].tobytes() if ok and j > i and not bad[i:j].any() and values[i:j].any() else None for i, j, ok in zip(ends[:-1], ends[1:], labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    label = embeddings.schema["label"].dataType.simpleString()
    return embeddings.mapInArrow(packed, f"vec_id bigint, label {label}, vec binary")


def _bucketed(classes: DataFrame, hashing: Hashing, kind: str) -> DataFrame:
    """key, t (table), node, size, vec: each class once in every table."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                salt = C.mixed(b.column("label_hash").to_numpy().view(np.uint64))
                for rows, unit in _unit(b.column("vec"), kind):
                    keys = C.mixed(hashing.keys(unit) ^ salt[rows, None])
                    take = pa.array(np.repeat(rows, hashing.tables))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(hashing.tables, dtype=np.int32), len(rows))), *(b.column(c).take(take) for c in ("node", "size", "vec"))], ["key", "t", "node", "size", "vec"])

    return classes.select("node", "size", "vec", F.xxhash64("label").alias("label_hash")).mapInArrow(dealt, "key bigint, t int, node bigint, size bigint, vec binary")


def _close(unit: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of rows (on different sides, if given) whose cosine reaches the bound, found strip by strip."""
    out = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for i in range(0, len(unit), STRIP):
        near = unit[i : i + STRIP] @ unit[i:].T
        close = near >= cosine - 1e-9
        if side is not None:
            close &= side[i : i + STRIP, None] != side[None, i:]
        a, b = np.nonzero(np.triu(close, 1))
        # A product's last bits vary with its shape; at the bound the plain sum decides, wherever the pair meets.
        edge = np.flatnonzero(near[a, b] < cosine + 1e-9)
        low = edge[_cosines(unit, i + a[edge], i + b[edge]) < cosine]
        out.append((np.delete(a, low).astype(np.int32) + np.int32(i), np.delete(b, low).astype(np.int32) + np.int32(i)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cosines(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plain sums of products of rows a and b."""
    out = [(unit[a[i : i + 20_000]] * unit[b[i : i + 20_000]]).sum(1) for i in range(0, len(a), 20_000)]
    return np.concatenate(out) if out else np.zeros(0)


def _pairs(unit: np.ndarray, start: np.ndarray, end: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of rows of one bucket (start to end) whose cosine reaches the bound; rows of one side that isn't -1 are no pair.

    Small buckets are compared all together, by the distance of two rows in their bucket.
    """
    few = end - start <= FEW
    row, last = np.arange(len(unit)), np.repeat(np.where(few, end, 0), end - start)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, FEW):
        a = row[row + d < last]
        a = a[(side[a] < 0) | (side[a] != side[a + d])]
        a = a[_cosines(unit, a, a + d) >= cosine]
        out.append((a, a + d))
    for i, j in zip(start[~few], end[~few], strict=True):
        a, b = _close(unit[i:j], side[i:j] if side[i] >= 0 else None, cosine)
        out.append((a + i, b + i))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _linked(dealt: DataFrame, groups: int, hashing: Hashing, kind: str) -> DataFrame:
    """Rows (u, v, n): with v an edge of a bucket's spanning forest, without v n more linked vectors of node u."""

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, size, table, key = (group.column(c).to_numpy() for c in ("node", "size", "t", "key"))
        lo, hi, own = (group.column(c).to_numpy() for c in ("lo", "hi", "own"))
        edges, counts = [], []
        for rows, unit in _unit(group.column("vec").combine_chunks(), kind):
            keys = hashing.keys(unit)
            order = np.lexsort((node[rows], hi[rows], lo[rows], key[rows]))
            r = rows[order]
            same = (key[r][1:] == key[r][:-1]) & (lo[r][1:] == lo[r][:-1]) & (hi[r][1:] == hi[r][:-1])
            start = np.flatnonzero(np.r_[True, ~same])
            # Of two blocks of a bucket: pairs inside a block have their own group.
            side = np.where(lo[r] != hi[r], own[r], -1)
            a, b = _pairs(unit[order], start, np.r_[start[1:], len(order)], side, hashing.cosine)
            root = C.roots(len(order), a, b)
            moved = np.flatnonzero(root != np.arange(len(order)))
            edges.append((node[r[moved]], node[r[root[moved]]]))
            first, met = np.ones(len(a), bool), table[r[a]]
            for t in range(hashing.tables):  # a pair counts in the first table in which it meets
                later = np.flatnonzero(first & (met > t))
                first[later] = keys[order[a[later]], t] != keys[order[b[later]], t]
            a, b = a[first], b[first]
            more = np.bincount(a, size[r[b]], len(order)) + np.bincount(b, size[r[a]], len(order))
            some = np.flatnonzero(more)
            counts.append((node[r[some]], more[some].astype(np.int64)))
        u = np.concatenate([x for x, _ in edges + counts] or [np.zeros(0, np.int64)])
        v = np.concatenate([y for _, y in edges] or [np.zeros(0, np.int64)])
        n = np.concatenate([y for _, y in counts] or [np.zeros(0, np.int64)])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(n), pa.int64())]), "n": pa.array(np.r_[np.zeros(len(v), np.int64), n], pa.int64())})

    part = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(groups))
    return dealt.groupBy(part.alias("part")).applyInArrow(compared, "u bigint, v bigint, n bigint")


def near_duplicates(embeddings: DataFrame, hashing: Hashing = Hashing()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings (vec_id, embedding, label).

    Vectors of equal labels and dimensions link when their cosine, in double precision, reaches the bound. n_links
    counts the other rows that link directly, repeated rows included; component_id is the smallest vec_id that
    links reach. Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing. Null ids join components but do not name them. Other columns are not read. An
    empty table gives an empty table.
    """
    element = embeddings.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = _vectors(embeddings.select("vec_id", "label", "embedding"), kind).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    rows = C.stored(rows, "vectors")
    classes = C.stored(rows.where(F.col("vec").isNotNull()).groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("vec_id").alias("low")), "classes")
    dealt = _bucketed(classes, hashing, kind)
    # Buckets beyond a block are cut into blocks; each pair of blocks is a group of its own.
    large = C.stored(dealt.groupBy("key").count().where(F.col("count") > BLOCK).select("key", "count", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = dealt.join(C.small_or_not(large.select("key", "blocks")), "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("key", "t", "node", "size", "vec", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    copies = large.agg(F.sum(F.col("count") * (F.col("blocks") - 1))).first()[0] or 0
    groups = max(1, (classes.count() * hashing.tables + copies) // GROUP_ROWS)
    found = C.stored(_linked(dealt, groups, hashing, kind), "links")
    part = C.components(found.where("v is not null").select("u", "v"))
    more = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("more"))
    placed = classes.select("node", "size", "low").join(more, "node", "left").join(part, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "low", F.coalesce("component_id", "node").alias("part"))
    names = placed.groupBy("part").agg(F.min("low").alias("component_id"))
    by_node = C.stored(placed.join(names, "part").select("node", "n_links", "component_id"), "names")
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
