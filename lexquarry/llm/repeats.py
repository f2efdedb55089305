"""Suffix-array dedup: exact removal of byte strings that earlier documents hold too.

Every string of LENGTH bytes is dealt out by its minimizer, the K bytes in it with the smallest hash, so equal
strings meet in one bucket wherever they come from. Neighbouring strings with one minimizer travel
together, as one passage of at most 2 * LENGTH - K bytes. Equal passages are collapsed before the shuffle: within a
batch of documents only those of the smallest document are sent on, as all strings of the others are repeats of it; a passage
that very many documents share thus reaches its bucket once a batch at most.

A minimizer that stands between many different words would make a hot bucket. Each of its strings also holds SIDE bytes before
or after it, so its passages are cut in two and dealt out by the longer context instead. A batch that has many passages of a
minimizer does so and tells the minimizer's bucket, which does the same with what it got from other batches; a
second shuffle takes these passages on.

There are more buckets the larger the corpus is, but a batch makes FAN rows of passages at most: with more buckets a number of a bucket has several
digits, batches are dealt by the first one, and what has one digit is put together to batches again and dealt by the next.

A bucket drops passages whose context occurs in one document only. The others are collapsed to distinct ones, whose
suffixes are sorted. From the Burrows-Wheeler transform of that order intervals are extended backwards, breadth first: the ends
of the intervals of length l mark where the common prefix of neighbouring suffixes is shorter than l.
This stops at LENGTH, so what stays unmarked lies inside the classes of equal strings of LENGTH bytes. A string is
removed from a document if its class has a smaller one.

What is shuffled is laid out byte by byte of its columns and compressed. Passages are compressed against a dictionary of some texts' beginnings, as with
many buckets a row holds few of them; it decides nothing but their size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import common as C

LENGTH, K = 50, 12
#: Bytes of text whose hashes are held at once, text of one batch of documents, passages of a bucket, and text of one transform. The first and the last
#: keep their arrays of 64-bit integers within a core's cache.
PIECE, GATHERED, BUCKET, TRANSFORM = 60_000, 8_000_000, 12_000_000, 120_000
#: Different passages of one minimizer in one batch of documents from which on the minimizer is hot.
HOT = 32
#: Buckets to which a batch is dealt at once.
FAN = 20_000
#: Slots of documents, to which spans are dealt: as many as buckets, but beyond LEAST_SLOTS one for SLOT of them only.
LEAST_SLOTS, SLOT = 1000, 8
#: Level at which passages are compressed; texts whose beginnings make the dictionary, and characters of each.
LEVEL, DICTIONARY_ROWS, DICTIONARY_CHARS = 3, 200, 600
#: Ends a passage; no byte of UTF-8 is equal to it.
STOP = 0xFF
LAST = np.iinfo(np.int64).max
BY_BYTE = C.fixed_random(256, 5)
SPANS = "doc_id bigint, th bigint, spans binary"
#: What is dealt to a bucket, or to the first digits of its number (depth of them): spans that are settled, or passages with contexts of width bytes;
#: and minimizers that are hot.
DEALT = "bucket bigint, depth int, width int, spans binary, passages binary, places binary, hot binary"
#: Every string of LENGTH bytes has at least so many bytes on one side of its minimizer.
SIDE = (LENGTH - K + 1) // 2
WIDE = K + SIDE


@dataclass(frozen=True)
class Radix:
    """Numbers of buckets with so many digits to the base fan."""

    fan: int
    digits: int

    @classmethod
    def of(cls, buckets: int, most: int) -> Radix:
        """As few digits as make so many buckets with a fan of at most most (2 at least), and the least fan with these."""
        digits = 1
        while max(most, 2) ** digits < buckets:
            digits += 1
        fan = max(1, round(buckets ** (1 / digits)) - 1)
        while fan**digits < buckets:
            fan += 1
        return cls(fan, digits)

    @property
    def buckets(self) -> int:
        return self.fan**self.digits

    @property
    def slots(self) -> int:
        return min(self.buckets, max(LEAST_SLOTS, self.buckets // SLOT))

    def of_key(self, key: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The first depth digits (all, if None) of a key's bucket."""
        rest = 0 if depth is None else self.digits - depth
        return (key % np.uint64(self.buckets) // np.uint64(self.fan**rest)).astype(np.int64)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of raw[i:i + K] for each i."""
    b = [np.uint64(pow(C.BASE, n, 2**64)) for n in (1, 2, 4)]
    one = BY_BYTE[raw]
    two = one[:-1] * b[0] + one[1:]
    four = two[:-2] * b[1] + two[2:]
    eight = four[:-4] * b[2] + four[4:]
    return C.mixed(eight[:-4] * b[2] + four[8:])


def _lowest(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of key[i:i + width] for each i."""
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    rest = width - step
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def _pieces(at: np.ndarray, most: int):
    """Ranges (first, end, upto): strings begin in first..end, their bytes are read up to upto."""
    for i, j in C.slices(at, most):
        if j - i > 1 or at[j] - at[i] <= most:
            yield at[i], at[j], at[j]
        else:
            for a in range(int(at[i]), int(at[j]), most):
                yield a, min(a + most, at[j]), min(a + most + LENGTH - 1, at[j])


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, number of strings, place of the minimizer, its hash, hash of the passage, and row, for each passage."""
    out = []
    for a, b, c in _pieces(at, PIECE):
        if c - a < LENGTH:
            continue
        seg = raw[a:c]
        h = _hashes(seg)
        # The place in the low bits makes the leftmost of equal hashes win.
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        place = (_lowest(key, LENGTH - K + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first_row, last_row = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
        rows = np.repeat(np.arange(first_row, last_row), np.minimum(at[first_row + 1 : last_row + 1], b) - np.maximum(at[first_row:last_row], a))
        n = min(len(place), b - a)
        inside = np.flatnonzero(at[rows[:n] + 1] >= a + np.arange(n) + LENGTH)
        if not len(inside):
            continue
        p = place[inside]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (np.diff(inside) != 1)])
        first, count = inside[new], np.diff(np.r_[new, len(inside)])
        out.append((a + first, count, a + p[new], h[p[new]], C.span_hashes(seg, first, first + count + LENGTH - 1, BY_BYTE), rows[first]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start:start + size] of all passages in a row."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(raw)) < 2**31 else np.int64
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(n, dtype=kind)
    return raw.take(at)


def _slots(ids: np.ndarray, th: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each document; copies of one text are dealt to different slots."""
    return (C.mixed(C.mixed(ids.view(np.uint64)) + th.view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _planes(x: np.ndarray, kind: type) -> list[memoryview]:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return [memoryview(p) for p in np.ascontiguousarray(np.ascontiguousarray(x.astype(kind))[:, None].view(np.uint8).T)]


def _read(frames: list[bytes], groups: int, columns: Sequence[tuple[int, type]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """From frames (lengths of the groups of columns, then the columns' planes): their lengths, and each (group, kind) column of all frames in a row."""
    planes = [[[] for _ in range(np.dtype(kind).itemsize)] for _, kind in columns]
    heads = np.empty((len(frames), groups), np.int64)
    for k, x in enumerate(frames):
        raw, heads[k], at = np.frombuffer(x, np.uint8), np.frombuffer(x, np.int64, groups), 8 * groups
        head = heads[k].tolist()
        for (group, _), column in zip(columns, planes, strict=True):
            for plane in column:
                plane.append(raw[at : at + head[group]])
                at += head[group]
    return heads, [np.ascontiguousarray(np.stack([np.concatenate(p) for p in column]).T).view(kind).ravel() for (_, kind), column in zip(columns, planes, strict=True)]


def _steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """x less the number before; those at first as they are."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def _summed(steps: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What _steps was made of, in ranges of so many."""
    first = (np.cumsum(many) - many)[many > 0]
    out = np.cumsum(steps)
    return out - np.repeat(out[first] - steps[first], many[many > 0])


#: Columns of spans: known, id (steps), th, start, length.
SPAN_COLUMNS = ((0, np.uint8), (0, np.int64), (0, np.int64), (0, np.uint32), (0, np.uint32))


def _packed(ids: np.ndarray, known: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray, slots: int) -> tuple[np.ndarray, list[bytes]]:
    """(slot, spans of all its documents in one binary) of spans, for each slot that has some."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    slot = _slots(ids, th, slots)
    order = np.lexsort((start, th, ids, slot))
    slot, start = slot[order], start[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
    columns = known[order], _steps(ids[order], first), th[order], start, end[order] - start
    planes = [p for x, (_, kind) in zip(columns, SPAN_COLUMNS, strict=True) for p in _planes(x, kind)]
    return slot[first], [squeeze(b"".join([np.int64(j - i).tobytes(), *(p[i:j] for p in planes)])) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(slot)], strict=False)]


def _unpacked(spans: pa.ChunkedArray) -> np.ndarray:
    """Rows (id, known, th, start, end) of _packed spans."""
    open_ = zstandard.ZstdDecompressor().decompress
    heads, (known, ids, th, start, size) = _read([open_(x.as_buffer()) for x in spans], 1, SPAN_COLUMNS)
    start = start.astype(np.int64)
    return np.column_stack([_summed(ids, heads[:, 0]), known.astype(np.int64), th, start, start + size])


def _split(start: np.ndarray, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(passage, start, number of strings, place of the context of WIDE bytes) of passages cut in two by their strings' longer side."""
    before = np.clip(place - SIDE - start + 1, 0, count)
    parts = [(np.arange(len(start)), start, before, place - SIDE), (np.arange(len(start)), start + before, count - before, place)]
    return tuple(np.concatenate([x[some] for x, some in zip(both, (parts[0][2] > 0, parts[1][2] > 0), strict=True)]) for both in zip(*parts, strict=True))


def _hashes_at(raw: np.ndarray, begin: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each (offset, width), hashes of raw[begin + offset:][:width] of all passages; they lie within a passage. Begins may come in any order."""
    out = [np.zeros(len(begin), np.uint64) for _ in spans]
    order = np.argsort(begin, kind="stable")
    at = begin[order]
    for a in range(0, len(raw), PIECE):
        i, j = np.searchsorted(at, [a, a + PIECE])
        if j > i:
            some = order[i:j]
            hashes = C.span_hasher(raw[a : a + PIECE + 2 * LENGTH], BY_BYTE)
            for into, (offset, width) in zip(out, spans, strict=True):
                start = at[i:j] - a + np.broadcast_to(offset, len(begin))[some]
                into[some] = hashes(start, start + np.broadcast_to(width, len(begin))[some])
    return out


def _rows(rows: Sequence[tuple]) -> pa.RecordBatch:
    """DEALT rows."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "depth", "width", "spans", "passages", "places", "hot"])


def _coder(words: bytes) -> dict:
    """Arguments for zstandard's classes: the dictionary, if there is one."""
    return {"dict_data": zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(words) >= 8 else {}


#: Columns of places, of documents: known, id (steps), th; of passages: place in the text, whether it is the first of its document, size, place of the minimizer.
PLACE_COLUMNS = ((1, np.uint8), (1, np.int64), (1, np.int64), (0, np.uint32), (0, np.uint8), (0, np.uint8), (0, np.uint8))


def _dealt(raw, start, count, place, key, width, inside, row, ids, known, th, radix: Radix, depth: int = 1, words: bytes = b"") -> Iterator[tuple]:
    """DEALT rows of passages, dealt by the first depth digits of key's bucket; inside is where a passage begins in its text, row that of ids, known and th.

    Rows rise with start. Places are laid out in the order of buckets at once; a row of DEALT only cuts its part out.
    """
    if not len(start):
        return
    coder = _coder(words)
    for x in coder.values():
        x.precompute_compress(level=LEVEL)
    squeeze, squeeze_places = zstandard.ZstdCompressor(level=LEVEL, **coder).compress, zstandard.ZstdCompressor(level=1).compress
    bucket = radix.of_key(key, depth)
    lowest = bucket.min()
    bucket -= lowest
    # Two stable sorts; that of numbers of 16 bits is linear.
    order = np.arange(len(start)) if (start[1:] >= start[:-1]).all() else np.argsort(start, kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if bucket.max() < 2**16 else np.int64), kind="stable")]
    bucket, row = bucket[order], row[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = count[order] + LENGTH - 1
    bytes_at = np.r_[0, np.cumsum(size)]
    new = np.r_[True, row[1:] != row[:-1]]
    new[first] = True
    docs_at = np.r_[0, np.cumsum(new)]
    docs = row[new]
    columns = known[docs], _steps(ids[docs], docs_at[first]), th[docs], inside[order], new, size, place[order] - start[order]
    planes = [(group, p) for x, (group, kind) in zip(columns, PLACE_COLUMNS, strict=True) for p in _planes(x, kind)]
    docs_at = docs_at[np.r_[first, len(order)]].tolist()
    digits, start, first = (bucket[first] + lowest).tolist(), start[order], np.r_[first, len(order)]
    del docs, columns, new, order, bucket
    # The bytes of about PIECE at a time.
    for g, upto in C.slices(bytes_at[first], PIECE):
        i, base = first[g], bytes_at[first[g]]
        data = memoryview(_gather(raw, start[i : first[upto]], size[i : first[upto]]))
        for n in range(g, upto):
            i, j, a, b = int(first[n]), int(first[n + 1]), docs_at[n], docs_at[n + 1]
            head = np.array([j - i, b - a], np.int64).tobytes()
            places = b"".join([head, *(p[a:b] if group else p[i:j] for group, p in planes)])
            yield digits[n], depth, width, None, squeeze(data[bytes_at[i] - base : bytes_at[j] - base]), squeeze_places(places), None


def deal(docs: DataFrame, radix: Radix, words: bytes = b"") -> DataFrame:
    """DEALT rows of documents (doc_id, th, text): passages dealt to buckets, and spans that a batch settles by itself (by slot)."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.gathered(batches, GATHERED):
            raw, at = C.flat(b.column("text"))
            known = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = np.where(known, b.column("doc_id").fill_null(LAST).to_numpy(), LAST)
            th = b.column("th").to_numpy()
            start, count, place, h, name, row = passages(raw, at)
            order = np.argsort(name)
            new = np.r_[True, (name[order][1:] != name[order][:-1]) | (h[order][1:] != h[order][:-1])][: len(order)]
            least = np.minimum.reduceat(ids[row[order]], np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
            later = ids[row[order]] > least
            gone, order = order[later], np.sort(order[~later])
            r = row[gone]
            slot, spans = _packed(ids[r], known[r], th[r], start[gone] - at[r], start[gone] + count[gone] + LENGTH - 1 - at[r], radix.slots)
            rows = [((k, radix.digits, 0, x, None, None, None) for k, x in zip(slot.tolist(), spans, strict=True))]
            _, of, many = np.unique(h[order], return_inverse=True, return_counts=True)
            hot = many[of] >= HOT
            cold, hot = order[~hot], order[hot]
            rows.append(_dealt(raw, start[cold], count[cold], place[cold], h[cold], K, start[cold] - at[row[cold]], row[cold], ids, known, th, radix, words=words))
            if len(hot):
                (told,) = _hashes_at(raw, place[hot], (0, K))
                told, one = np.unique(told, return_index=True)
                bucket = radix.of_key(h[hot][one])
                o = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[o], return_index=True)
                rows.append([(k, radix.digits, 0, None, None, None, told[o[i:j]].tobytes()) for k, i, j in zip(used.tolist(), first, np.r_[first[1:], len(o)], strict=True)])
                which, s, c, p = _split(start[hot], count[hot], place[hot])
                of = row[hot[which]]
                rows.append(_dealt(raw, s, c, p, _hashes_at(raw, p, (0, WIDE))[0], WIDE, s - at[of], of, ids, known, th, radix, words=words))
            del order, new, least, later, gone, many, name, h
            yield from map(_rows, batched(chain.from_iterable(rows), 32))

    return docs.select("doc_id", "th", "text").mapInArrow(dealt, DEALT)


def _opened(passages: pa.Array, places: pa.Array, words: bytes = b"") -> tuple[np.ndarray, ...]:
    """data (all passages in a row), ids, known, th of documents, and of passages where they begin in their texts, row of ids, size and place of the minimizer."""
    open_, open_places = zstandard.ZstdDecompressor(**_coder(words)).decompress, zstandard.ZstdDecompressor().decompress
    heads, (known, ids, th, inside, new, size, place) = _read([open_places(x.as_buffer()) for x in places], 2, PLACE_COLUMNS)
    data = np.concatenate([np.frombuffer(open_(x.as_buffer()), np.uint8) for x in passages])
    return data, _summed(ids, heads[:, 1]), known.astype(np.int64), th, inside.astype(np.int64), np.cumsum(new, dtype=np.int64) - 1, size.astype(np.int64), place.astype(np.int64)


def _key(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """By what passages with contexts of width bytes, at these places of data, are dealt: the hashes of _hashes and _hashes_at, of these places only."""
    out = np.zeros(len(at), np.uint64)
    for k in range(K) if width == K else reversed(range(WIDE)):
        out = out * np.uint64(C.BASE) + BY_BYTE[data[at + k]]
    return C.mixed(out if width == K else out + np.uint64(WIDE))


def deal_on(dealt: DataFrame, depth: int, most: float, radix: Radix, words: bytes = b"") -> DataFrame:
    """DEALT rows with passages of so many digits dealt by one more; others are passed on. most is the expected number of bytes of passages with the same digits.

    Rows with the same digits lie together in their task and are opened in batches of about GATHERED bytes, whatever their number.
    """

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for width in (K, WIDE):
                mine = t.filter(pc.equal(t.column("width"), width)).combine_chunks()
                if mine.num_rows:
                    data, ids, known, th, inside, row, many, place = _opened(mine.column("passages"), mine.column("places"), words)
                    begin = np.cumsum(many) - many
                    rows = _dealt(data, begin, many - LENGTH + 1, begin + place, _key(data, begin + place, width), width, inside, row, ids, known != 0, th, radix, depth + 1, words)
                    yield from map(_rows, batched(rows, 32))

        for b in batches:
            open_ = pc.and_(pc.is_valid(b.column("places")), pc.equal(b.column("depth"), depth))
            rest = b.filter(pc.invert(open_))
            if rest.num_rows:
                yield rest
            b = b.filter(open_)
            digits = b.column("bucket").to_numpy()
            bytes_ = [zstandard.frame_content_size(x.as_buffer()[:18]) for x in b.column("passages")]
            for i in range(b.num_rows):
                if held and (size >= GATHERED * 3 or held[-1].column("bucket")[0].as_py() != digits[i]):
                    yield from out()
                    held, size = [], 0
                held.append(b.slice(i, 1))
                size += bytes_[i]
        if held:
            yield from out()

    tasks = max(1, int(most // (GATHERED * 3)))
    salt = F.pmod(F.xxhash64(F.coalesce("places", "spans", "hot")), F.lit(tasks))
    return dealt.repartition("bucket", salt).sortWithinPartitions("bucket").mapInArrow(again, DEALT)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of passages, each of at most 2 * LENGTH - K bytes and a STOP: ranks of 8 bytes, put together until a passage is covered.

    What follows a STOP does not order suffixes.
    """
    n = len(text)
    left = np.flatnonzero(text == STOP)
    left = left[np.searchsorted(left, np.arange(n))] - np.arange(n) + 1 if len(left) and left[-1] == n - 1 else np.full(n, n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(i < left, padded[i : n + i], np.uint64(0))
    covered = 8
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        if covered > 2 * LENGTH - K or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        # As many ranks as fit into 63 bits, two at least.
        base = int(np.count_nonzero(new)) + 1
        times = max(2, min(int(62 / np.log2(base)), -(-(2 * LENGTH - K + 1) // covered)))
        key = rank.copy()
        for k in range(covered, covered * times, covered):
            key *= base
            key[:-k] += np.where(k < left[:-k], rank[k:], 0)
        covered *= times


def equal_strings(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and, along it, the class of each suffix's first LENGTH bytes (numbers rise from 0).

    Breadth-first backward extension over the Burrows-Wheeler transform: an interval of suffixes that begin with a string w
    is extended by each byte c before them to the interval of cw, whose end is marked; intervals whose end was
    marked before are not extended again, as all their extensions would meet marks.
    """
    n = len(text)
    order = suffix_order(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    to = np.empty(n, np.int32)
    to[by_byte] = np.arange(n, dtype=np.int32)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    marked = np.zeros(n + 1, bool)
    marked[0] = True
    low = np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]]).astype(np.int32)
    high = np.r_[low[1:], np.int32(n)]
    marked[high] = True
    every = np.arange(n, dtype=np.int32)
    for _ in range(LENGTH - 1):
        size = high - low
        ends = np.cumsum(size, dtype=np.int32)
        x = np.repeat(low - (ends - size), size) + every[: ends[-1]]
        # The first and the last place of each byte in an interval bound the extended interval.
        new_low = np.sort(to[x[preceding[x] < np.repeat(low, size)]])
        new_high = np.sort(to[x[following[x] >= np.repeat(high, size)]]) + np.int32(1)
        fresh = ~marked[new_high]
        marked[new_high] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    return order, np.cumsum(marked[:n]) - 1


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same key."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(low < high, np.diff(np.r_[first, len(key)]))
    return out


def repeated(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, from, to) of what is removed from passages data[begin:begin + size], in bytes of the passage, to exclusive.

    Strings meet by the width bytes at place; groups of more than TRANSFORM bytes meet by a longer context.
    """
    if width == K:
        low = np.maximum(place - SIDE, 0)
        h, name, left, right = _hashes_at(data, begin, (place, K), (0, size), (low, place + K - low), (place, np.minimum(size - place, WIDE)))
        pick = np.flatnonzero(_shared(h, doc))
        full_left, full_right = place[pick] >= SIDE, size[pick] - place[pick] >= WIDE
        keep = np.zeros(len(pick), bool)
        keep[full_left] = _shared(left[pick[full_left]], doc[pick[full_left]])
        keep[full_right] |= _shared(right[pick[full_right]], doc[pick[full_right]])
        pick = pick[keep]
    else:
        h, name = _hashes_at(data, begin, (place, WIDE), (0, size))
        pick = np.flatnonzero(_shared(h, doc))
    pick = pick[np.lexsort((doc[pick], name[pick], h[pick]))]
    out = [(np.zeros(0, np.int64),) * 3]
    first = np.flatnonzero(np.r_[True, h[pick][1:] != h[pick][:-1]][: len(pick)])
    ends = np.r_[first[1:], len(pick)][: len(first)]
    total = np.r_[0, np.cumsum(size[pick] + 1)]
    if width == K:
        large = np.repeat(total[ends] - total[first] > TRANSFORM, ends - first)
        which, s, c, p = _split(begin[pick[large]], size[pick[large]] - LENGTH + 1, begin[pick[large]] + place[pick[large]])
        of = pick[large][which]
        w, a, b = repeated(data, s, c + LENGTH - 1, p - s, doc[of], WIDE)
        out.append((of[w], a + (s - begin[of])[w], b + (s - begin[of])[w]))
        pick = pick[~large]
        first = np.flatnonzero(np.r_[True, h[pick][1:] != h[pick][:-1]][: len(pick)])
        ends = np.r_[first[1:], len(pick)][: len(first)]
        total = np.r_[0, np.cumsum(size[pick] + 1)]
    # Transforms of whole groups, of about TRANSFORM bytes.
    last = 0
    for g in ends:
        if total[g] - total[last] >= TRANSFORM or g == len(pick):
            out.append(_removed(data, begin, size, name, h, doc, pick[last:g]))
            last = g
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _removed(data, begin, size, name, h, doc, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for passages pick, sorted by minimizer, passage and document; equal passages are transformed once."""
    new = np.r_[True, (name[pick][1:] != name[pick][:-1]) | (h[pick][1:] != h[pick][:-1])]
    one = pick[new]  # of equal passages the smallest document's comes first
    of = np.cumsum(new) - 1
    ends = np.cumsum(size[one] + 1)
    text = np.full(ends[-1], STOP, np.uint8)
    at = ends - size[one] - 1
    text[np.repeat(at - (np.cumsum(size[one]) - size[one]), size[one]) + np.arange(size[one].sum())] = _gather(data, begin[one], size[one])
    owner = np.repeat(np.arange(len(one)), size[one] + 1)
    inside = np.arange(len(text)) - at[owner]
    order, kind = equal_strings(text)
    least = np.where(inside <= size[one][owner] - LENGTH, doc[one][owner], LAST)[order]
    least = np.minimum.reduceat(least, np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]))
    smallest = np.empty(len(text), np.int64)
    smallest[order] = least[kind]
    # Copies of a passage in larger documents go whole; of the smallest document's, strings that a smaller one has.
    later = doc[pick] > doc[one][of]
    whole = pick[later]
    string = np.flatnonzero((inside <= size[one][owner] - LENGTH) & (smallest < doc[one][owner]))
    first = np.flatnonzero(np.r_[True, (np.diff(string) != 1) | (owner[string][1:] != owner[string][:-1])][: len(string)])
    last = np.r_[first[1:], len(string)][: len(first)] - 1
    who, start, end = owner[string[first]], inside[string[first]], inside[string[last]] + LENGTH
    # All places of the smallest document's passage.
    kept = np.flatnonzero(~later)
    many = np.bincount(of[kept], minlength=len(one))
    before = np.cumsum(many) - many
    times = many[who]
    index = np.repeat(before[who], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.r_[whole, pick[kept[index]]], np.r_[np.zeros(len(whole), np.int64), np.repeat(start, times)], np.r_[size[whole], np.repeat(end, times)]


def settle(dealt: DataFrame, width: int, radix: Radix, words: bytes = b"") -> DataFrame:
    """DEALT rows: spans of a slot's documents, from all buckets' passages with contexts of width bytes; spans and passages of another width are passed on."""

    def settled(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own = pc.and_(pc.is_valid(group.column("places")), pc.equal(group.column("width"), width))
        out = [group.filter(pc.and_(pc.invert(own), pc.is_null(group.column("hot"))))]
        mine = group.filter(own)
        if not mine.num_rows:
            return out[0]
        data, ids, known, th, start, row, size, place = _opened(mine.column("passages"), mine.column("places"), words)
        begin = np.cumsum(size) - size
        told = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hot") if x.is_valid]
        hot = np.isin(_hashes_at(data, begin, (place, K))[0], np.concatenate(told)) if told else np.zeros(len(size), bool)
        if hot.any():
            which, s, c, p = _split(begin[hot], size[hot] - LENGTH + 1, (begin + place)[hot])
            of = np.flatnonzero(hot)[which]
            rows = _dealt(data, s, c, p, _hashes_at(data, p, (0, WIDE))[0], WIDE, start[of] + s - begin[of], row[of], ids, known != 0, th, radix, words=words)
            out.append(pa.Table.from_batches([_rows(list(rows))]))
        cold = np.flatnonzero(~hot)
        which, a, b = repeated(data, begin[cold], size[cold], place[cold], ids[row[cold]], width)
        which = cold[which]
        slot, spans = _packed(ids[row[which]], known[row[which]], th[row[which]], start[which] + a, start[which] + b, radix.slots)
        out.append(pa.Table.from_batches([_rows([(k, radix.digits, 0, x, None, None, None) for k, x in zip(slot.tolist(), spans, strict=True)])]))
        return pa.concat_tables([x.cast(out[-1].schema) for x in out])

    return dealt.groupBy("bucket").applyInArrow(settled, DEALT)


def merged(rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """From rows (id, known, th, start, end) one row (id, known, th) for each document, and its spans sorted and joined where they overlap or touch."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]
    # Documents are laid out one after the other, so that one running maximum serves all of them.
    base = (np.cumsum(new) - 1) * (rows[:, 4].max() + 2)
    start, upto = rows[:, 3] + base, np.maximum.accumulate(rows[:, 4] + base)
    first = np.flatnonzero(np.r_[True, (start[1:] > upto[:-1]) | new[1:]])
    pairs = np.column_stack([rows[first, 3], upto[np.r_[first[1:], len(rows)] - 1] - base[first]])
    docs = np.flatnonzero(new[first])
    return rows[first[docs], :3], [pairs[i:j].tobytes() for i, j in zip(docs, np.r_[docs[1:], len(first)], strict=True)]


def measured(docs: DataFrame) -> tuple[int, Column]:
    """Bytes of all texts, and what tells rows with the same doc_id apart: a hash of the text if ids repeat, else nothing."""
    total, most = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("m")).agg(F.sum("n"), F.max("m")).first()
    return total or 0, F.xxhash64(docs["text"]) if (most or 0) > 1 else F.lit(0).cast("long")


def repeats(docs: DataFrame, total: int, name: Column) -> DataFrame:
    """doc_id, th (name) and spans (merged, as pairs of 64-bit integers) of documents with something to remove; total and name as measured."""

    def joined(group: pa.Table) -> pa.Table:
        keys, spans = merged(_unpacked(group.column("spans")))
        return pa.table({"doc_id": pa.array(keys[:, 0], pa.int64(), mask=keys[:, 1] == 0), "th": pa.array(keys[:, 2], pa.int64()), "spans": pa.array(spans, pa.binary())})

    docs = docs.select("doc_id", name.alias("th"), "text")
    radix = Radix.of(max(1, total * 7 // 2 // BUCKET), FAN)
    words = "".join(r[0] for r in docs.where("text is not null").select(F.left("text", F.lit(DICTIONARY_CHARS))).limit(DICTIONARY_ROWS).collect()).encode()

    def onward(rows: DataFrame) -> DataFrame:
        for depth in range(1, radix.digits):
            rows = deal_on(rows, depth, total * 3.5 / radix.fan**depth, radix, words)
        return rows

    first = C.stored(settle(onward(deal(docs, radix, words)), K, radix, words), "settled")
    hot = first.where("passages is not null")
    second = settle(onward(hot.where(F.col("depth") < radix.digits)).union(hot.where(F.col("depth") == radix.digits)), WIDE, radix, words)
    return first.where("spans is not null").union(second).groupBy("bucket").applyInArrow(joined, SPANS)


def remove(docs: DataFrame) -> DataFrame:
    """docs' columns with kept (binary: the UTF-8 bytes left) and spans (array of start, end: bytes removed).

    A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller doc_id; null ids
    come after all others. Strings don't cross documents and are judged on the input. Null texts count as
    empty. Rows that repeat an id are not repeats of each other; all rows are kept. Columns named kept or spans are
    replaced. An empty table gives an empty table. Passages are told apart by two 64-bit hashes.
    """
    total, name = measured(docs)
    found = C.stored(repeats(docs, total, name), "repeats")
    i, th, mine, cut_ = C.fresh(docs, "id", "th", "mine", "cut")
    found = found.select(F.col("doc_id").alias(i), F.col("th").alias(th), F.col("spans").alias(mine))
    joined = docs.join(C.light_or_not(found, F.length(mine) + 100), docs["doc_id"].eqNullSafe(F.col(i)) & (name == F.col(th)), "left")

    @F.arrow_udf("struct<kept:binary,spans:array<struct<start:bigint,end:bigint>>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans, strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                pairs = np.frombuffer(s.as_buffer(), np.int64).reshape(-1, 2).tolist() if s.is_valid else []
                edges = [0, *(x for p in pairs for x in p), len(raw)]
                out.append({"kept": b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), "spans": [{"start": i, "end": j} for i, j in pairs]})
            yield pa.array(out, kind)

    out = joined.withColumn(cut_, cut("text", mine)).drop(i, th, mine)
    return out.withColumn("kept", F.col(cut_)["kept"]).withColumn("spans", F.col(cut_)["spans"]).drop(cut_)
