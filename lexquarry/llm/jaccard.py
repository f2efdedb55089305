"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set holds the hashes of its distinct three-word shingles. Sets are joined by size band (the band
of the larger one). Two sets of a band that reach the threshold differ in at most H tokens, so when tokens are
hashed into more than H segments, some segment is equal in both. Each set is indexed by the hashes of its
segments' contents, for its own band and for the next one, in which it can be the smaller set. By a cost estimate
a band either has H + 1 + SPARE exact segments, of which a set with at most SPARE empty ones skips these,
or H // 2 + 1 segments with one-deletion neighbourhoods (some segment then differs in one token at most).

Sets with a segment in common are verified exactly. Groups that share a segment are not expanded into
pairs: within a batch of sets, and then over all batches, members are compared with the smallest one. Where members are then
still in different components, the group is open. Open groups chain sets to clusters. A cluster that fits a block is compared as a
whole, in one matrix product; of a larger one only the sets that share a segment are compared, group by group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm import common as C

SHINGLE, SLICE_BYTES, SPARE = 3, 1_000_000, 2
#: What a set that must index empty segments, and a segment of one token or none, cost in signatures.
EMPTY_COST, NARROW_COST = 10_000, 100
#: Sets and bytes of sets of one block of a cluster; cells of an incidence matrix.
BLOCK_SETS, BLOCK_BYTES, CELLS = 1000, 8_000_000, 10_000_000
#: Bytes of signatures that are grouped before the shuffle.
GATHERED = 16_000_000
BY_BYTE = C.fixed_random(256, 8)
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SET_SCHEMA = "doc_id bigint, th bigint, n bigint, node bigint, sigs array<bigint>"


def _collisions(size: int, segments: int, spare: int) -> float:
    """Estimated cost of empty and narrow segments when size tokens fall into them at random (Poisson counts)."""
    mean = size / segments
    empty = segments * np.exp(-mean)
    too_many = max(0.0, 1 - np.exp(-empty) * sum(empty**k / math.factorial(k) for k in range(spare + 1)))
    return EMPTY_COST * segments * too_many + NARROW_COST * segments * (1 + mean) * np.exp(-mean)


def bands(percent: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowest size, largest difference H, number of segments and whether deletions are indexed, for each band up to size top."""
    low, far, segments, deletions = [], [], [], []
    # Smaller sets have no other partner than an equal set.
    lo = next(n for n in range(1, 1000) if 2 * n * (100 - percent) >= 100 + percent)
    while lo <= top:
        hi = lo * 100 // percent
        h = 2 * hi * (100 - percent) // (100 + percent)
        exact, with_deletions = h + 1 + SPARE, h // 2 + 1
        cost = [exact + _collisions(lo, exact, SPARE), with_deletions + lo + _collisions(lo, with_deletions, SPARE)]
        low.append(lo)
        far.append(h)
        deletions.append(bool(cost[1] < cost[0]))
        segments.append(with_deletions if deletions[-1] else exact)
        lo = hi + 1
    return np.array(low), np.array(far), np.array(segments), np.array(deletions)


def shingles(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash."""
    raw = LOWER[raw]
    start, end, row = C.word_spans(raw, at, IN_WORD)
    words = C.span_hashes(raw, start, end, BY_BYTE)
    n = len(at) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first[row]
    # A shingle begins at each word that has size - 1 more words after it; a shorter text is one shingle.
    begins = np.flatnonzero((place + size <= counts[row]) | ((place == 0) & (counts[row] < size)))
    length = np.minimum(size, counts[row[begins]])
    h = length.astype(np.uint64)
    for k in range(size):
        have = length > k
        h[have] = C.mixed(h[have] * np.uint64(C.BASE) + words[begins[have] + k])
    of = row[begins]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])][: len(of)]
    return of[new], h[new]


def _sums(cell: np.ndarray, h: np.ndarray, cells: int) -> np.ndarray:
    """Sums of 64-bit hashes by cell, modulo 2**64; exact, as halves are summed apart."""
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for all sets: what two sets that reach the threshold have in common at least once."""
    low, _, segments, deletions = bands(percent, max(int(sizes.max(initial=1)) * 100 // percent + 1, 100))
    own = np.searchsorted(low, sizes, "right") - 1
    rows, sigs = [], []
    for step in (0, 1):
        band = own + step
        # In the next band a set can only be the smaller one of a pair.
        use = (band >= 0) & (band < len(low)) & (sizes > 0) & (sizes * 100 >= percent * low[np.clip(band, 0, len(low) - 1)])
        if not use.any():
            continue
        m = np.where(use, segments[np.clip(band, 0, len(low) - 1)], 0)
        base = np.cumsum(m) - m
        pick = use[row]
        r, x = row[pick], h[pick]
        cell = base[r] + (C.mixed(x ^ np.uint64(0x5EED)) % m[r].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums, filled = _sums(cell, x, total), np.bincount(cell, minlength=total)
        of = np.repeat(np.arange(len(m)), m)
        salt = C.mixed(band[of].astype(np.uint64) * np.uint64(0x10001) + (np.arange(total) - base[of]).astype(np.uint64) + np.uint64(1))
        empty = np.bincount(of[filled == 0], minlength=len(m))
        with_deletions = deletions[np.clip(band, 0, len(low) - 1)]
        keep = (filled > 0) | (empty[of] > SPARE) | with_deletions[of]
        rows.append(of[keep])
        sigs.append(C.mixed(sums[keep] ^ salt[keep]))
        less = with_deletions[r]
        rows.append(r[less])
        sigs.append(C.mixed((sums[cell[less]] - x[less]) ^ salt[cell[less]]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def sets(docs: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """SET_SCHEMA rows, one for each row of docs (doc_id, text): size and key of the set, and its signatures."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = C.flat(b.column("text"))
            for i, j in C.slices(at, SLICE_BYTES):
                row, h = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], size)
                n = np.bincount(row, minlength=j - i)
                node = C.mixed(_sums(row, C.mixed(h), j - i) + n.astype(np.uint64))
                of, sig = signatures(row, h, n, percent)
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n, pa.int64()), pa.array(node.view(np.int64)), lists], ["doc_id", "th", "n", "node", "sigs"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(made, SET_SCHEMA)


def contents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, tokens) for rows of docs (node, text): the sorted set as 64-bit integers in a binary."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = C.flat(b.column("text"))
            for i, j in C.slices(at, SLICE_BYTES):
                row, h = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], size)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array([h[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "tokens"])

    return docs.mapInArrow(made, "node bigint, tokens binary")


def shared_signatures(one: DataFrame) -> DataFrame:
    """(sig, node, n, low, low_n) for each signature that several sets of one (node, n, sigs) have.

    Within a batch a signature's sets point to the smallest of them, and only that one is shuffled on under the signature:
    it points to the smallest of all batches. So a signature that very many sets have makes a row a batch.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.gathered(batches, GATHERED):
            node, n, lists = b.column("node").to_numpy(), b.column("n").to_numpy(), b.column("sigs")
            sig, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((node[row], sig))
            sig, row = sig[order], row[order]
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (row[1:] != row[:-1])][: len(sig)]
            sig, row = sig[fresh], row[fresh]
            first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
            size = np.diff(np.r_[first, len(sig)])
            low = np.repeat(row[first], size)
            alone = row == low
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node[row]), pa.array(n[row]), pa.array(node[low], mask=alone), pa.array(n[low], mask=alone), pa.array(np.repeat(size > 1, size))], ["sig", "node", "n", "low", "low_n", "led"])

    # What points to nothing is null: nearly all rows are of signatures that one set has, and nulls shuffle as next to nothing.
    found = one.select("node", "n", "sigs").mapInArrow(grouped, "sig bigint, node bigint, n bigint, low bigint, low_n bigint, led boolean")
    # The smallest of a batch has its signature's window; the others, whose place is known, have one each.
    window = Window.partitionBy("sig", F.when(F.col("low").isNotNull(), F.col("node")))
    found = found.select("*", F.min(F.struct("node", "n")).over(window).alias("least"), F.max("node").over(window).alias("most"))
    shared = found.where(F.col("led") | (F.col("least.node") != F.col("most")))
    return shared.select("sig", "node", "n", F.coalesce("low", "least.node").alias("low"), F.coalesce("low_n", "least.n").alias("low_n"))


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold.

    The sets v of one u are dealt to several groups, each of which gets u's set once.
    """

    def checked(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        u, v, salt, sets = *(group.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "salt")), group.column("tokens").combine_chunks()
        own = ~group.column("v").is_valid().to_numpy()
        order = np.lexsort((~own, salt, u))
        keep, mine = [], np.zeros(0, np.uint64)
        for k in order.tolist():
            other = np.frombuffer(sets[k].as_buffer(), np.uint64)
            if own[k]:
                mine = other
                continue
            at = np.searchsorted(mine, other)
            both = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
            if 100 * both >= percent * (len(mine) + len(other) - both):
                keep.append(k)
        return group.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    many, size = pairs.count(), tokens.agg(F.avg(F.length("tokens"))).first()[0] or 0
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(max(64, many // BLOCK_SETS))))
    right = salted.join(tokens.withColumnRenamed("node", "v"), "v").select("u", "v", "salt", "tokens")
    left = salted.select("u", "salt").distinct().join(tokens.withColumnRenamed("node", "u"), "u").select("u", F.lit(None).cast("long").alias("v"), "salt", "tokens")
    key = F.pmod(F.xxhash64("u", "salt"), F.lit(int(2 * many * size) // BLOCK_BYTES + 1))
    return left.union(right).groupBy(key.alias("key")).applyInArrow(checked, "u bigint, v bigint")


def links(docs: DataFrame, made: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Verified links (u, v) between different sets; enough of them for the components of all links."""
    one = made.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sigs").alias("sigs"), F.min(F.struct("doc_id", "th")).alias("row"))
    one = C.stored(one, "sets")
    shared = C.stored(shared_signatures(one), "shared")
    fits = F.greatest("n", "low_n") * percent <= F.least("n", "low_n") * 100
    stars = C.stored(shared.where((F.col("node") != F.col("low")) & fits).select(F.col("low").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    wanted = C.stored(shared.select("node").distinct().join(one.select("node", "row"), "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.th").alias("th")), "wanted")
    C.release(one)
    texts = docs.join(C.small_or_not(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th"))).select("node", "text")
    tokens = C.stored(contents(texts, size).dropDuplicates(["node"]), "tokens")
    found = C.stored(verified(stars, tokens, percent), "links")
    C.release(stars, wanted)
    part = C.components(found)
    placed = C.stored(shared.join(part, "node", "left").select("sig", "node", F.coalesce("component_id", "node").alias("part"), "low"), "placed")
    C.release(shared)
    # Open groups; of those with the same members one is enough.
    mixed = placed.groupBy("sig").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("least <> most")
    mixed = mixed.groupBy("members", "n").agg(F.min("sig").alias("sig")).select("sig", "n")
    open_ = C.stored(C.spread_join(placed, mixed, "sig", placed.count()).select("sig", "node", "part", "low"), "open")
    C.release(placed)
    cluster = C.components(open_.select(F.col("low").alias("u"), F.col("node").alias("v"))).withColumnRenamed("component_id", "cluster")
    nodes = C.stored(open_.select("node", "part").distinct().join(cluster, "node").join(tokens.select("node", F.length("tokens").alias("bytes")), "node"), "nodes")
    large = nodes.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("bytes").alias("bytes")).where((F.col("sets") > BLOCK_SETS) | (F.col("bytes") > BLOCK_BYTES)).select("cluster")
    large = C.small_or_not(large)
    whole = nodes.join(large, "cluster", "left_anti").select(F.xxhash64(F.lit("cluster"), "cluster").alias("group"), "node", "part", "bytes")
    apart = open_.select("sig", "node").join(nodes.join(large, "cluster", "left_semi").select("node", "part", "bytes"), "node").select(F.xxhash64(F.lit("sig"), "sig").alias("group"), "node", "part", "bytes")
    members = C.stored(whole.union(apart), "members")
    C.release(open_)
    return found.union(compared(members, tokens, percent))


def _linked(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets in different components (and on different sides, if given) that reach the threshold.

    Sizes of intersections are the product of the sets' incidence matrix with itself, over tokens in two sets at least.
    """
    size = np.array([len(x) for x in sets])
    token, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    dense = np.cumsum(many > 1) - 1
    keep = many[code] > 1
    row, column = row[keep], dense[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(64, CELLS // len(sets))
    width = int((many > 1).sum())
    for first in range(0, width, step):
        i, j = np.searchsorted(column, [first, first + step])
        matrix = np.zeros((len(sets), min(step, width - first)), np.float32)
        matrix[row[i:j], column[i:j] - first] = 1
        both += matrix @ matrix.T
    fits = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    fits &= part[:, None] != part[None, :]
    if side is not None:
        fits &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(fits, 1))


def compared(members: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members (node, part, group, bytes) of a group whose parts differ; tokens (node, tokens) has their sets.

    Groups are compared inside tasks and no pairs are written but links. A group beyond BLOCK_SETS sets or
    BLOCK_BYTES is cut into blocks, and each pair of blocks is a task's work of its own.
    """
    size = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("bytes").alias("bytes"))
    size = size.select("group", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"), "bytes")
    total = size.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    # Few groups have more than one block, as each of these fills one.
    cut = C.small_or_not(size.where("blocks > 1").select("group", "blocks"))
    dealt = members.join(cut, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(tokens, "node")
    dealt = dealt.select("group", "node", "part", "tokens", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def checked(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        group, node, part, own, lo, hi = (rows.column(c).to_numpy() for c in ("group", "node", "part", "own", "lo", "hi"))
        tokens = rows.column("tokens").combine_chunks()
        order = np.lexsort((node, hi, lo, group))
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])]
        first = np.flatnonzero(new)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(first, np.r_[first[1:], len(order)], strict=True):
            some = order[i:j]
            side = own[some] if lo[some[0]] != hi[some[0]] else None
            a, b = _linked([np.frombuffer(tokens[int(r)].as_buffer(), np.uint64) for r in some], part[some], side, percent)
            # One link for each pair of components is enough.
            pairs = np.column_stack([part[some[a]], part[some[b]]])
            one = np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)[1] if len(a) else a
            u.append(node[some[a[one]]])
            v.append(node[some[b[one]]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    key = F.pmod(F.xxhash64("group", "lo", "hi"), F.lit(max(1, total // BLOCK_BYTES)))
    return dealt.groupBy(key.alias("key")).applyInArrow(checked, "u bigint, v bigint")


def join(docs: DataFrame, percent: int = 90, size: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id for each row of docs (doc_id, text).

    Words are what stands between ASCII spaces, A-Z in lower case; a set holds the distinct shingles of size words, a
    text of fewer words is one shingle. Two documents link when 100 * intersection >= percent * union; component_id
    is the smallest doc_id that links reach. Null texts and texts without words have no set, link with nothing
    and keep their own id. Rows that repeat an id are documents of their own with that id; null ids join components
    but do not name them. Other columns are not read. An empty table gives an empty table. Shingles and sets are told
    apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    made = C.stored(sets(docs, percent, size), "shingles")
    part = C.components(links(docs, made, percent, size))
    low = made.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = low.join(part, "node", "left").select("node", "low", F.coalesce("component_id", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("low").alias("component_id"))
    names = C.stored(named.join(least, "part").select("node", "component_id"), "names")
    out = made.select("doc_id", "th", F.col("n").alias("n_shingles"), "node").join(names, "node", "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 90) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the one with its smallest id.

    Rows that repeat that id in one component are all kept, and so are rows without a set.
    """
    found = C.stored(join(docs, percent), "classes")
    i, th = C.fresh(docs, "id", "th")
    drop = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(i), F.col("th").alias(th)).distinct()
    drop = C.small_or_not(C.stored(drop, "copies"))
    return docs.join(drop, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")
