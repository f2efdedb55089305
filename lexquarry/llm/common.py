"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.text import let
from lexquarry.sources.store import release, scratch, stored

__all__ = ["let", "release", "scratch", "stored"]  # shared with the rest of the library

#: Upper bounds, in rows of bounded width or in bytes, of what is broadcast explicitly; beyond them the join is left to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000
#: Keys whose rows are joined where they are, at most; rows up to which a key is never one of these.
HEAVY_KEYS, LIGHT_KEY = 100_000, 2000
#: Edges of a graph that one task contracts.
EDGES = 50_000


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, one for each stem (names differ by case at least)."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem = "_" + stem
        taken.add(stem.lower())
        out.append(stem)
    return out


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows, as it is otherwise. For rows of bounded width."""
    return F.broadcast(df) if df.count() <= rows else df


def light_or_not(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if size, summed over its rows, is at most so many bytes, as it is otherwise."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row a key with the number of its rows as column n; total is the number of rows.

    Keys with more than total / HEAVY_KEYS rows, of which there are HEAVY_KEYS at most, are broadcast; their rows stay where
    they are. So a shuffle has no key with more rows than that.
    """
    most = max(LIGHT_KEY, total // HEAVY_KEYS)
    if total <= most:
        return rows.join(keyed, key)
    heavy = F.broadcast(keyed.where(F.col("n") > most))
    light = rows.join(heavy.select(key), key, "left_anti").join(keyed.where(F.col("n") <= most), key)
    return rows.join(heavy, key).unionByName(light)


#: Rows of an Arrow batch that suit texts of any length: the Python workers share an executor's memory.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows. For applications; operators leave the session alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def gathered(batches, most: int):
    """Arrow batches put together until they hold so many bytes or more."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32 (of the id as text) is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that pairs (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From edges (u, v), for each node an edge to the least one that these edges reach."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, ends = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
        root = roots(len(nodes), *np.split(ends, 2))
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[root[moved]], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long) by alternating large-star and small-star steps.

    Returns (node, component_id) with the smallest id of each component, for every node that has an
    edge to another one. First, tasks of about EDGES edges each replace theirs by stars. A step then takes each node's smallest
    neighbour, with map-side combine, and joins it to the node's edges by spread_join, so a hub is no task's work. Rounds end
    with a checkpoint and their number grows with the logarithm of the longest path.
    """

    def joined(edges: DataFrame, total: int) -> DataFrame:
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return spread_join(edges, low, "u", total).select("u", "v", F.least("u", "m").alias("m"))

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    e = e.coalesce(e.count() // EDGES + 1).mapInArrow(_contracted, "u bigint, v bigint").checkpoint()
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(e.select("v", "v").distinct())
        mark = seen
        large = joined(e.union(e.select("v", "u")), 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        e = joined(large, seen[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()


# ---- flat views of Arrow string columns, for numpy ----


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets (one more than texts). Null counts as empty."""
    a = pc.fill_null(texts.cast(pa.large_string()), "") if texts.null_count else texts.cast(pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int):
    """Row ranges (i, j) of at most so many bytes each; a longer row has a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def fixed_random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)


#: Powers by base, kept by a task.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    if len(out) <= 1 << 23:
        _POWERS[base] = out
    return out[:n]


def span_hasher(raw: np.ndarray, by_byte: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends: a 64-bit hash of each raw[start:end], equal for equal spans wherever they stand."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(by_byte[raw] * powers(BASE, n), out=sums[1:])
    back = powers(BASE_INVERSE, n + 1)
    return lambda start, end: mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, by_byte: np.ndarray) -> np.ndarray:
    return span_hasher(raw, by_byte)(start, end)


def word_spans(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with in_word, cut at row borders, and each one's row."""
    is_word = in_word[raw]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


# ---- native text helpers ----


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


NO_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)"


def _in_blocks(array: Column, body: Callable[[Column], Column]) -> Column:
    """body of consecutive slices of an array that isn't empty, each of about as many elements as there are slices."""
    step = F.ceil(F.sqrt(F.size(array))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(array), step), lambda at: body(F.slice(array, at, step)))


def running(array: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative add over an array of longs, zero first.

    Folding in blocks keeps the copies of growing arrays small: n**1.5 elements rather than n**2.
    """
    none = F.expr("cast(array() as array<bigint>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def fold(values: Column, last: Callable[[Column], Column], after: bool) -> Column:
        def step(state: Column, x: Column) -> Column:
            total = add(state["at"], last(x))
            return F.struct(total.alias("at"), F.concat(state["out"], F.array(total if after else state["at"])).alias("out"))

        return F.aggregate(values, zero, step, lambda state: state["out"])

    def whole(values: Column) -> Column:
        inner = _in_blocks(values, lambda block: fold(block, lambda x: x, True))
        return let(inner, lambda blocks: F.flatten(F.zip_with(blocks, fold(blocks, lambda b: F.element_at(b, -1), False), lambda b, before: F.transform(b, lambda x: add(before, x)))))

    return F.when(F.size(array) > 0, let(array, whole)).otherwise(none)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, hit), in code points, end exclusive.

    What split() leaves between the matches gives their places.
    """
    split = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
        return F.zip_with(running(lengths, lambda a, b: a + b), x["hits"], lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))

    return F.when(text.rlike(pattern), let(split, placed)).otherwise(F.expr(NO_SPANS))


def cuts(text: Column, ranges: Column) -> Column:
    """The substrings of a text at ranges (start, end), which rise and don't overlap; at least one.

    A block of ranges is cut out first, so that a long text isn't read from its start for each of them.
    """

    def of_block(block: Column) -> Column:
        first, last = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        part = lambda a, b, t: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
        return let(F.struct(first.alias("at"), part(first, last, text).alias("text")), lambda x: F.transform(block, lambda r: part(r["start"] - x["at"], r["end"] - x["at"], x["text"])))

    return let(ranges, lambda all_: F.flatten(_in_blocks(all_, lambda block: let(block, of_block))))
