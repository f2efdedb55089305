"""Maximal periodic runs of words, and texts with each run cut down to its first period.

A run is a maximal stretch of words with smallest period q whose length is at least max(24, 3 q). Runs are found with
string synchronising sets. At the scale t = 4, 8, 16, ... a set holds the places i whose t-word fragment, or the one t
words on, has the least hash of all fragments that begin at i .. i + t. Fragments of period t/3 or less take no part:
they lie in runs that smaller scales have found, and those runs, as the separately detected highly periodic regions,
are what tells them apart. Membership depends on 2 t words only, and each stretch of 3 t - 1 words holds a member unless
its period is t/3 or less. So every run with a period q of 1.5 t <= q < 3 t has a member near its start, and the
member q words on has the same 2 t words. Pairs of members with equal contexts and such a distance propose
periods, which are extended word by word; equal hashes alone decide nothing. Periods under 6 are read directly.

Members with equal contexts are more than t/3 apart, so a member has at most nine partners, and a text of n words
takes about n log(n)**2 steps whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import common as C

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 24, 3
#: The smallest scale; periods under 1.5 times that are read directly.
FIRST_SCALE = 4
#: Bytes of text whose words are worked on together (a longer text is worked on alone), and cells of a block of comparisons.
TEXT_BYTES, CELLS = 2 << 20, 1 << 20
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_NONE = np.iinfo(np.uint64).max


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of fragments put together from two halves."""
    return C.mixed(left * np.uint64(C.BASE) + C.mixed(right + np.uint64(1)))


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x moved n places to the front, zeros behind."""
    out = np.zeros_like(x)
    out[: max(len(x) - n, 0)] = x[n:]
    return out


def _least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """For each i with i + n in reach, the least of x[i .. i + n]; n is a power of two."""
    low, width = x, 1
    while width < n:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(x) - n], x[n:])


def _mismatches(words: np.ndarray, at: np.ndarray, distance: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """From each place at, going by step, the first place that differs from the one a distance on, or limit if that comes first."""
    out, active, width, last = limit.copy(), np.flatnonzero((limit - at) * step > 0), 16, len(words) - 1
    at = at.copy()
    while len(active):
        left = []
        for part in np.array_split(active, -(-len(active) * width // CELLS)):
            here = at[part, None] + step * np.arange(width)
            differs = words[np.clip(here, 0, last)] != words[np.clip(here + distance[part, None], 0, last)]
            found = differs.any(1)
            first = at[part] + step * differs.argmax(1)
            hit = part[found]
            out[hit] = np.minimum(first[found] * step, limit[hit] * step) * step
            at[part] += step * width
            left.append(part[~found & ((limit[part] - at[part]) * step > 0)])
        active, width = np.concatenate(left), min(2 * width, 4096)
    return out


def _stretches(words: np.ndarray, at: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """The maximal stretches of the proposed periods that have EXPONENT periods: start, length, period.

    A proposal is compared up to the next one of the same period, so that a stretch is read once for each period.
    """
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    same = distance[1:] == distance[:-1]
    limit = np.full(len(at), len(words), np.int64)
    limit[:-1][same] = at[1:][same]
    end = _mismatches(words, at, distance, limit, 1)
    linked = np.concatenate([[False], same & (end[:-1] == at[1:])])
    head = np.flatnonzero(~linked)
    tail = np.append(head[1:], len(at)) - 1
    begin = _mismatches(words, at[head] - 1, distance[head], np.full(len(head), -1, np.int64), -1) + 1
    length, period = end[tail] - begin + distance[head], distance[head]
    long = length >= EXPONENT * period
    return [begin[long], length[long], period[long]]


def _short_periods(words: np.ndarray) -> Iterator[list[np.ndarray]]:
    for q in range(1, FIRST_SCALE * 3 // 2):
        equal = np.zeros(max(len(words) - q, 0) + 2, bool)
        equal[1:-1] = words[q:] == words[: max(len(words) - q, 0)]
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        start, length = edges[::2], edges[1::2] - edges[::2] + q
        long = length >= EXPONENT * q
        yield [start[long], length[long], np.full(int(long.sum()), q)]


def _members(hashes: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The places of the synchronising set of a scale."""
    values = np.where(periodic, _NONE, hashes)
    low = _least_ahead(values, scale)
    return np.flatnonzero((low != _NONE) & ((low == values[: len(low)]) | (low == values[scale:])))


def find(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of some texts: text number, start, length and smallest period, in order of text, start and period.

    words holds the words of all texts in a row, as whole numbers from 0 that are equal for equal words.
    """
    # a mark that nothing else equals stands before each text and behind the last one, so that no stretch crosses texts
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    first = np.cumsum(lengths) - lengths + np.arange(n) + 1
    flat = np.empty(len(words) + n + 1, np.int64)
    flat[np.append(first - 1, len(flat) - 1)] = -1 - np.arange(n + 1)
    flat[np.arange(len(words)) + row + 1] = words

    found = list(_short_periods(flat))
    place, text_of = np.arange(len(flat)), np.append(np.repeat(np.arange(n), lengths + 1), n)
    hashes = C.mixed(flat.astype(np.uint64) * np.uint64(C.BASE))
    scale = 1
    while True:
        if scale >= FIRST_SCALE:
            long = np.append(lengths * 2 >= 9 * scale, True)[text_of]  # three periods of 1.5 scales; the last mark stays
            if long.sum() <= 1:
                break
            flat, place, text_of, hashes = flat[long], place[long], text_of[long], hashes[long]
            periodic = np.zeros(len(flat) + 1, np.int64)
            for start, length, period in found:
                inside = (period <= scale // EXPONENT) & (length >= scale)
                start, length = start[inside], length[inside]
                here = np.minimum(np.searchsorted(place, start), len(place) - 1)
                kept = place[here] == start
                np.add.at(periodic, here[kept], 1)
                np.add.at(periodic, here[kept] + length[kept] - scale + 1, -1)
            at = _members(hashes, np.cumsum(periodic[:-1]) > 0, scale)
            context = _paired(hashes, _ahead(hashes, scale))[at]
            order = np.argsort(context, kind="stable")
            at, context = at[order], context[order]
            proposed, k = [], 1
            while k < len(at):
                apart = np.where(context[k:] == context[:-k], at[k:] - at[:-k], 3 * scale)
                if apart.min() >= 3 * scale:
                    break
                pick = np.flatnonzero((2 * apart >= 3 * scale) & (apart < 3 * scale))
                proposed.append((at[:-k][pick], apart[pick]))
                k += 1
            if proposed and sum(len(p[0]) for p in proposed):
                start, length, period = _stretches(flat, *(np.concatenate(x) for x in zip(*proposed, strict=True)))
                found.append([place[start], length, period])
        hashes = _paired(hashes, _ahead(hashes, scale))
        scale *= 2

    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))  # of equal stretches the smallest period comes first and is kept
    start, length, period = start[order], length[order], period[order]
    keep = length >= LEAST
    keep[1:] &= (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((period, start, text))
    return text[order], start[order] - first[text[order]], length[order], period[order]


def _worked(texts: pa.Array) -> pa.StructArray:
    raw, at = C.flat(texts)
    begin, end, row = C.word_spans(raw, at, IN_WORD)
    lengths = np.bincount(row, minlength=len(texts)).astype(np.int64)
    letters = raw[IN_WORD[raw]]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = find(numbers, lengths)

    base = np.cumsum(lengths) - lengths
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, base[text] + start + period, 1)
    np.add.at(dropped, base[text] + start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(texts)))])
    left = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), words.filter(pa.array(kept)))
    collapsed = pc.binary_join(left, pa.scalar(" ", pa.large_string()))
    runs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
    n_runs = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(n_runs, pa.int32()), runs), collapsed.cast(pa.string())], ["n_words", "runs", "collapsed"])


def runs(text: Column, text_bytes: int = TEXT_BYTES) -> Column:
    """struct<n_words, runs, collapsed> of whole texts, worked out together in batches of bounded bytes.

    runs holds (start, length, period) of every run, in words from 0, by start and then period. collapsed is the text
    without the words that some run contains after its first period, with one space between words. Words stand
    between white space of ASCII. A null or empty text, or one without words, has no runs and collapses to ''.
    """

    @F.arrow_udf(RESULT)
    def worked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            at = C.flat(b)[1]
            parts = [_worked(b.slice(i, j - i)) for i, j in C.slices(at, text_bytes)]
            yield pa.concat_arrays(parts) if parts else _worked(b)

    return worked(text)


def collapse(docs: DataFrame, text: str = "text", text_bytes: int = TEXT_BYTES) -> DataFrame:
    """docs with n_words, runs and collapsed.

    Every row is kept, repeated ones and those with null ids too; columns of those names are replaced. Each text is worked on by
    itself, where it lies: nothing is shuffled. An empty table gives an empty table.
    """
    (found,) = C.fresh(docs, "found")
    out = docs.withColumn(found, runs(F.col(text), text_bytes))
    return out.withColumns({name: F.col(found)[name] for name in ("n_words", "runs", "collapsed")}).drop(found)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; the first of equal ones; null without a run."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
