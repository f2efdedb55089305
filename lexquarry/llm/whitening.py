"""Whitening of embeddings from exact integer statistics.

Entries are quantised to whole numbers. A batch's whole numbers, moved so that the least of each dimension is zero,
are cut into bit planes, and each plane of each dimension is packed across rows into 64-bit words. The
popcount of the AND of two planes, weighted by the planes' place values, adds up to the exact product sums
of two dimensions. Batches report whole numbers of any size, Spark adds them as decimals, and the covariance is centred in
whole numbers (n times the product sums, less the product of the sums) before it becomes double precision for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import common as C

#: Quantisation: x = floor(SCALE * c) + SHIFT. Sums are taken of x - SHIFT, which changes no covariance.
SCALE, SHIFT = 64, 1_000_000
#: Bytes of vectors that are packed or projected together, and of planes that are ANDed in one step.
PACK_BYTES, STEP_BYTES = 8 << 20, 1 << 21
#: x - SHIFT is held to +-2**62, which only entries beyond 2**56 reach.
MOST = 1 << 62
COMPONENTS = 32
#: Eigenvalues under this share of the greatest are rounding of zero.
RANK = 1e-13


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as long, without SHIFT."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def packed(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The bit planes of whole numbers from 0 (rows by dimensions), packed across rows: planes x words, dimension by dimension, and the number of planes of each."""
    depth = [int(v).bit_length() for v in x.max(0)] if len(x) else [0] * x.shape[1]
    planes = np.zeros((sum(depth), -(-len(x) // 64) * 8), np.uint8)
    at = 0
    for k, bits in enumerate(depth):
        column = np.ascontiguousarray(x[:, k]).astype(np.uint64)
        for b in range(bits):
            row = np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            planes[at, : len(row)] = row
            at += 1
    return planes.view(np.uint64), depth


def common_bits(planes: np.ndarray) -> np.ndarray:
    """For each pair of planes, the number of rows that have both bits."""
    n = len(planes)
    out = np.zeros((n, n), np.int64)
    step = max(1, STEP_BYTES // max(planes[:1].nbytes, 1))
    for i in range(n):
        for j in range(i, n, step):
            out[i, j : j + step] = np.bitwise_count(planes[i] & planes[j : j + step]).sum(1, dtype=np.int64)
    return np.maximum(out, out.T)


def products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """The exact sums of whole numbers by dimension, and of their products by pair of dimensions, by bit planes."""
    low = [int(v) for v in x.min(0)]
    planes, depth = packed((x.astype(object) - low) if any(abs(v) >= MOST // 2 for v in low) else x - np.array(low, np.int64))
    bits, place, dims = common_bits(planes), np.concatenate([np.arange(d) for d in depth] + [[]]).astype(int), x.shape[1]
    kind = np.int64 if 2 * max(depth, default=0) + len(x).bit_length() < 63 else object
    weighted = bits.astype(kind) * np.array([1 << int(p) for p in place], dtype=kind)[:, None] * np.array([1 << int(p) for p in place], dtype=kind)
    edges = np.concatenate([[0], np.cumsum(depth)]).astype(int)
    of = np.zeros((dims, len(place)), kind)
    for k in range(dims):
        of[k, edges[k] : edges[k + 1]] = 1
    moved = of.dot(weighted).dot(of.T)
    ones = np.diag(bits).astype(object) * [1 << int(p) for p in place]
    sums = [int(sum(ones[edges[k] : edges[k + 1]])) for k in range(dims)]
    n = len(x)
    total = [s + n * v for s, v in zip(sums, low, strict=True)]
    # what moving took out: sum (y_i + a_i)(y_j + a_j) = sum y_i y_j + a_i sum y_j + a_j sum y_i + n a_i a_j
    crossed = [[int(moved[i, j]) + low[i] * sums[j] + low[j] * sums[i] + n * low[i] * low[j] for j in range(dims)] for i in range(dims)]
    return total, crossed


@dataclass
class Whitening:
    """What a fit knows: number of vectors, sums of x by dimension, mean, components (rows), their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for quantised vectors (without SHIFT), exact: longs where they fit, else Python's whole numbers."""
        sums = [s - self.n * SHIFT for s in self.sums]
        most = max((int(np.abs(x).max()) if x.size else 0) * self.n, max(map(abs, sums), default=0))
        return x * np.int64(self.n) - np.array(sums, np.int64) if most < 1 << 61 else x.astype(object) * self.n - np.array(sums, object)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (NaN along components without variance)."""
        centred = (self.deviations(x) / self.n).astype(np.float64)
        scale = np.sqrt(self.values)
        return np.where(scale > 0, centred @ self.components.T / np.where(scale > 0, scale, 1), np.nan)


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not empty and holds finite entries only."""
    v = F.col(vector)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: number(c.cast("double"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return quantised(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes of quantised vectors each."""
    rows = max(64, size // (8 * dims) // 64 * 64)
    for b in C.gathered(batches, size):
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, size: int = PACK_BYTES) -> Whitening | None:
    """Whitening fitted to all vectors of a table; None without any.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part. If vectors differ in length, those of the
    most frequent length are fitted (the greater one of equally frequent lengths). Components are unit eigenvectors of the
    covariance (divisor n) by falling eigenvalue; eigenvalues that are zero but for rounding are set to zero. Tasks report
    one row for each pair of dimensions, which are added up with a combiner; the driver gets one number a pair.
    """
    good = _vectors(df, vector).select(F.col(vector).alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    dims = sizes["d"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, crossed = 0, [0] * dims, [[0] * dims for _ in range(dims)]
        for b in _blocks(batches, dims, size):
            x = _matrix(b.column("v"), dims)
            part, pairs = products(x)
            n += len(x)
            sums = [a + p for a, p in zip(sums, part, strict=True)]
            crossed = [[a + p for a, p in zip(row, new, strict=True)] for row, new in zip(crossed, pairs, strict=True)]
        if n:
            keys = [(-1, -1, n), *((-1, i, sums[i]) for i in range(dims)), *((i, j, crossed[i][j]) for i in range(dims) for j in range(i, dims))]
            i, j, total = zip(*keys, strict=True)
            # halves of 62 bits keep any total within a decimal
            high, low = [t >> 62 for t in total], [t & (1 << 62) - 1 for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(high), _decimals(low)], ["i", "j", "high", "low"])

    parts = good.where(F.size("v") == dims).mapInArrow(summed, "i int, j int, high decimal(38,0), low decimal(38,0)")
    got = {(r["i"], r["j"]): (int(r["high"]) << 62) + int(r["low"]) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n, sums = got[-1, -1], [got[-1, i] for i in range(dims)]
    centred = [[n * got[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(centred[i][i] for i in range(dims)) / n / n
    # dividing whole numbers rounds once
    v = np.array([[c / (n * n) for c in row] for row in centred])
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values = np.where(values[order] > RANK * max(values.max(), 0), values[order], 0.0)
    return Whitening(n, [s + n * SHIFT for s in sums], np.ascontiguousarray(columns[:, order].T), values, trace)


def _decimals(whole: list[int]) -> pa.Array:
    return pa.array([Decimal(w) for w in whole], pa.decimal128(38, 0))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", size: int = PACK_BYTES) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over all vectors.

    Components without variance are left out; 0 if there is no other.
    """
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0
    dims, n, m = model.dims, model.n, len(live)
    good = _vectors(df, vector).select(F.col(vector).alias("v")).where(F.size("v") == dims)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for b in _blocks(batches, dims, size):
            w = np.column_stack([model.project(_matrix(b.column("v"), dims))[:, live], np.ones(b.num_rows)])
            total += w.T @ w
        i, j = np.triu_indices(m + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    got = np.zeros((m + 1, m + 1))
    for r in good.mapInArrow(summed, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["total"]
    mean = got[:m, m] / n
    return float(np.abs(got[:m, :m] / n - np.outer(mean, mean) - np.eye(m)).max())


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but the vector) of the rows that fit() takes, one row for each component.

    Adds component (from 1), n, deviation (sum over dimensions of (n*x - S)**2, exact; null beyond a long), whitened (null along
    a component without variance) and explained (share of the trace; null if that is zero); columns of those names
    are replaced. Rows are kept as often as they occur. Without a model the result is empty.
    """
    added = ["component", "n", "deviation", "whitened", "explained"]
    keep = [c for c in (keep if keep is not None else df.columns) if c != vector and c.lower() not in added]
    (cells,) = C.fresh(df, "cells")
    kept = df.select(*keep, vector)
    cell = "struct<component:int,n:bigint,deviation:bigint,whitened:double,explained:double>"
    if model is None:
        return kept.where(F.lit(False)).select(*keep, *(F.lit(None).cast(kind).alias(a) for a, kind in zip(added, ("int", "bigint", "bigint", "double", "double"), strict=True)))

    @F.arrow_udf(f"array<{cell}>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = len(model.values)
        explained = pa.array([float(e) / model.trace if model.trace > 0 else None for e in model.values], pa.float64())
        for b in batches:
            x = _matrix(b, model.dims)
            apart = model.deviations(x)
            bound = max(int(np.abs(apart).max()) if apart.size else 0, 1) ** 2 * model.dims
            if bound < 1 << 63:
                squares = (apart * apart).sum(1)
                deviation = pa.array(np.repeat(squares.astype(np.int64), m))
            else:
                exact = [sum(int(a) ** 2 for a in row) for row in apart]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact for _ in range(m)], pa.int64())
            white = model.project(x).reshape(-1)
            columns = [pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(white), model.n, np.int64)), deviation, pa.array(white, from_pandas=True), explained.take(pa.array(np.tile(np.arange(m), len(x))))]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m, pa.int32()), pa.StructArray.from_arrays(columns, added))

    rows = _vectors(kept, vector).where(F.size(vector) == model.dims).withColumn(cells, projected(F.col(vector)))
    return rows.select(*keep, F.explode(cells).alias(cells)).select(*keep, *(F.col(cells)[a].alias(a) for a in added))
