"""Pairs of texts whose sets of word shingles overlap, by the pigeonhole principle.

Sets are joined by size band (that of the larger one). Two sets of a band that reach the bound differ in at most H shingles, so when
shingles are hashed into more than H parts, some part is equal in both. Only hashes of parts are shuffled (6 bytes each, packed by batch), neither texts
nor shingles. Texts that share a part are compared by sketches first, parities of shingles' hashes in 2 to 4 bits a shingle: a shingle that one set
has alone changes one parity, so as many parities differ at most as shingles do, and no pair is lost. Sets are read and sent for pairs that are left only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import let, words
from lexquarry.operators.lexical import small
from lexquarry.sources.store import release, stored

#: Parts that may be empty in both of two sets; hashings that are tried for sets with more empty parts.
SPARE, TURNS = 2, 6
#: Steps over which texts find the least one around them.
ROUNDS = 3
#: Characters of text whose signatures meet in one call, and texts that are packed together (their places take two bytes); shingles that are hashed at once; bytes, sets and pairs of what is compared in one call; texts up to which their numbers are broadcast.
BUCKET_CHARS, PLACES, SLICE, BLOCK_BYTES, BLOCK_SETS, BLOCK_PAIRS, BROADCAST = 30_000_000, 4096, 200_000, 8_000_000, 1000, 1_000_000, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(cell: np.ndarray, h: np.ndarray, cells: int) -> np.ndarray:
    """Sums of 64-bit hashes by cell, modulo 2**64; exact, as halves are summed apart."""
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return low + (high << np.uint64(32))


def bands(percent: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest size and largest difference H of each band up to size top. Smaller sets than the first band's have no other partner there than an equal set."""
    low, far = [], []
    lo = next(n for n in range(1, 1000) if 2 * n * (100 - percent) >= 100 + percent)
    while lo <= top:
        hi = lo * 100 // percent
        low.append(lo)
        far.append(2 * hi * (100 - percent) // (100 + percent))
        lo = hi + 1
    return np.array(low), np.array(far)


def signatures(sizes: np.ndarray, h: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets that follow each other in h: sets that reach the bound have one in common at least.

    A set is indexed in its own band and in the next, in which it can be the smaller one. Of more than H + SPARE parts more than SPARE are equal in
    both sets, so one of these is not empty if either set has at most SPARE empty parts. Sets with more are hashed anew, and
    those that have them each time are indexed by empty parts too.
    """
    row, h = np.repeat(np.arange(len(sizes)), sizes), _mixed(h)
    low, far = bands(percent, max(int(sizes.max(initial=1)) * 100 // percent + 1, 100))
    own = np.searchsorted(low, sizes, "right") - 1
    least = np.flatnonzero((own < 0) & (sizes > 0))
    rows, sigs = [least], [_mixed(_sums(row, h, len(sizes))[least])]
    for step in (0, 1):
        at = np.clip(own + step, 0, len(low) - 1)
        use = (own + step >= 0) & (own + step < len(low)) & (sizes > 0) & (sizes * 100 >= percent * low[at])
        for turn in range(TURNS):
            if not use.any():
                break
            m = np.where(use, far[at] + 1 + SPARE, 0)
            base, total = np.cumsum(m) - m, int(m.sum())
            r, x = row[use[row]], h[use[row]]
            cell = base[r] + (_mixed(x ^ np.uint64(0x5EED + turn)) % m[r].astype(np.uint64)).astype(np.int64)
            filled, of = np.bincount(cell, minlength=total), np.repeat(np.arange(len(m)), m)
            salt = _mixed(((at[of] * TURNS + turn) * 0x1000001 + np.arange(total) - base[of] + 1).astype(np.uint64))
            use = use & (np.bincount(of[filled == 0], minlength=len(m)) > SPARE)
            keep = (filled > 0) | ((turn == TURNS - 1) & use[of])
            rows.append(of[keep])
            sigs.append(_mixed(_sums(cell, x, total)[keep] ^ salt[keep]))
    return np.concatenate(rows), np.concatenate(sigs)


PACKED = "bucket int, sigs binary, places binary, nodes binary"


def _packed(sig: np.ndarray, of: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures of one batch's texts in a row for each bucket: 48 bits of each, its text's place in a list, and this list."""
    bucket = ((sig >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    rows: list[list[bytes]] = [[], [], []]
    for part in np.split(order, first[1:]):
        listed, place = np.unique(of[part], return_inverse=True)
        rows[0].append(np.ascontiguousarray(sig[part].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
        rows[1].append(place.astype(np.uint16).tobytes())
        rows[2].append(node[listed].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["bucket", "sigs", "places", "nodes"])


def _signed(percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, PLACES) for b in batches for i in range(0, b.num_rows, PLACES)):
            node, lists = b.column("node").to_numpy(), b.column("grams")
            once = np.sort(np.unique(node, return_index=True)[1])  # equal texts are one
            node, lists = node[once], lists.take(pa.array(once))
            sizes, h = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
            ends, of, sig, i = np.append(0, np.cumsum(sizes)), [], [], 0
            while i < len(node):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
                some = signatures(sizes[i:j], h[ends[i] : ends[j]], percent)
                of.append(i + some[0])
                sig.append(some[1])
                i = j
            if sum(map(len, sig)):
                yield _packed(np.concatenate(sig), np.concatenate(of), node, buckets)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """(sig, node) of one bucket's signatures that several texts have. Those of 48 bits that happen to be equal only add pairs to compare."""
    sigs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, p, n in zip(*(rows.column(c) for c in ("sigs", "places", "nodes")), strict=True):
        wide = np.zeros((len(p.as_buffer()) // 2, 8), np.uint8)
        wide[:, :6] = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, 6)
        sigs.append(wide.view(np.int64).ravel())
        nodes.append(np.frombuffer(n.as_buffer(), np.int64)[np.frombuffer(p.as_buffer(), np.uint16)])
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    some = np.r_[False, same] | np.r_[same, False]
    sig, node = sig[some[: len(sig)]], node[order[some[: len(sig)]]]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
    sig, node = sig[new], node[new]
    same = sig[1:] == sig[:-1]
    some = (np.r_[False, same] | np.r_[same, False])[: len(sig)]
    return pa.table({"sig": (sig[some] << 16) ^ rows.column("bucket")[0].as_py(), "node": node[some]})


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, data): of each set its size and the parities of how many of its shingles fall on each of 2**k places, twice as many as shingles or more."""
    for b in batches:
        data, sizes = [], []
        for k in range(b.num_rows):
            h = _mixed(b.column("grams")[k].values.to_numpy().view(np.uint64))
            places = 1 << max(6, int(2 * len(h) - 1).bit_length())
            data.append(np.packbits(np.bincount((h % np.uint64(places)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes())
            sizes.append(len(h))
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["node", "n", "data"])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities on fewer places: those of hashes modulo 2**k are sums of those modulo 2**(k + 1)."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _near_sketches(percent: int):
    """Of the pairs (u, v) of a call those whose sketches do not differ in more places than sets that reach the bound can."""

    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        n, at = sent.column("n").to_pylist(), {x: i for i, x in enumerate(sent.column("node").to_pylist())}
        data = [np.frombuffer(x.as_buffer(), np.uint8) for x in sent.column("data")]
        keep = []
        for k, (u, v) in enumerate(zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True)):
            i, j = at[u], at[v]
            if min(n[i], n[j]) * 100 < percent * max(n[i], n[j]):
                continue
            size = min(len(data[i]), len(data[j]))
            if int(np.bitwise_count(_folded(data[i], size) ^ _folded(data[j], size)).sum()) * (100 + percent) <= (100 - percent) * (n[i] + n[j]):
                keep.append(k)
        return pairs.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _near_sets(percent: int):
    """Of the pairs (u, v) of a call those that reach the bound."""

    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        at, data = {x: i for i, x in enumerate(sent.column("node").to_pylist())}, [np.frombuffer(x.as_buffer(), np.int64) for x in sent.column("data")]
        keep = []
        for k, (u, v) in enumerate(zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True)):
            a, b = data[at[u]], data[at[v]]
            both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
            if both * 100 >= percent * (len(a) + len(b) - both):
                keep.append(k)
        return pairs.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [np.sort(b.column("grams")[k].values.to_numpy()) for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(map(len, data), pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())], ["node", "n", "data"])


def _compared(pairs: DataFrame, made: DataFrame, check) -> DataFrame:
    """The pairs (u, v) that check leaves, by rows of made (node, n, data), each of which is sent to few calls of bounded size."""
    both = lambda df, *keys: df.select(*keys, F.col("u").alias("node")).union(df.select(*keys, F.col("v"))).distinct()
    sizes = stored(made.groupBy("node").agg(F.max(F.length("data") + 100).alias("bytes")), "sizes")
    # A pair goes to the least of the texts around its first one, so that texts which are near each other meet in one place, and there to a pair of blocks.
    linked, label = pairs.union(pairs.select("v", "u")).toDF("node", "other"), sizes.select("node", F.col("node").alias("head"))
    for _ in range(ROUNDS):
        near = linked.join(label.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        label = stored(label.join(near, "node").select("node", F.least("head", "near").alias("head")), "heads")
    placed = stored(pairs.join(label.withColumnRenamed("node", "u"), "u"), "placed")
    cut = both(placed, "head").join(sizes, "node").groupBy("head").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.col("blocks"))
    dealt = stored(placed.join(cut, "head").select("u", "v", F.xxhash64("head", block("u"), block("v")).alias("group")), "dealt")
    release(placed)
    room = both(dealt, "group").join(sizes, "node").agg(F.sum("bytes")).first()[0] or 0
    calls = max(room // BLOCK_BYTES, dealt.count() // BLOCK_PAIRS) + 1
    dealt = dealt.select("u", "v", F.pmod("group", F.lit(calls)).alias("call"))
    to = stored(both(dealt, "call").toDF("to", "node"), "sent")
    sent = made.join(small(to, BROADCAST), "node").select("to", "node", "n", "data")
    return dealt.groupBy("call").cogroup(sent.groupBy("to")).applyInArrow(check, "u bigint, v bigint")


def _shingles(text: Column, size: int) -> Column:
    """The distinct hashes of a text's runs of size words; a shorter text is one run."""
    none = F.array().cast("array<bigint>")

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        return F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)

    return F.array_distinct(let(words(F.lower(text)), grams))


def near_pairs(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """u, v: pairs of the first ids of different texts whose sets of word shingles overlap by percent or more.

    Equal texts are one. Texts and shingles are told apart by 64-bit hashes; sizes of intersections are exact.
    """
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("node"))
    buckets = min((docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS + 1, 65_536)
    signed = texts.select("node", _shingles(F.col("text"), size).alias("grams")).mapInArrow(_signed(percent, buckets), PACKED)
    shared = stored(signed.groupBy("bucket").applyInArrow(_shared, "sig bigint, node bigint"), "shared-signatures")
    pairs = stored(shared.withColumnRenamed("node", "u").join(shared.withColumnRenamed("node", "v"), "sig").where("u < v").select("u", "v").distinct(), "candidates")
    release(shared)

    def made(pairs: DataFrame, form, name: str) -> tuple[DataFrame, DataFrame]:
        wanted = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "wanted")
        met = texts.select("node", "doc_id").join(small(wanted, BROADCAST), "node")
        first = stored(met.groupBy(F.col("node").alias("own")).agg(F.min("doc_id").alias("id")), "first-ids")
        # The first id's text is read; rows that repeat both make the same row again.
        one = texts.join(small(first, BROADCAST), (F.col("node") == F.col("own")) & (F.col("doc_id") == F.col("id"))).select("node", _shingles(F.col("text"), size).alias("grams"))
        return first, stored(one.mapInArrow(form, "node bigint, n bigint, data binary"), name)

    _, sketches = made(pairs, _sketched, "sketches")
    near = stored(_compared(pairs, sketches, _near_sketches(percent)), "near")
    release(pairs, sketches)
    first, sets = made(near, _sorted, "sets")
    found = _compared(near, sets, _near_sets(percent)).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v")
    return found.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
