"""Byte-pair encoding and decoding with a public vocabulary file.

Words of a batch that have not been seen are laid out as one flat array of symbols. In each round
every word's lowest-rank pair is found by binary search over the sorted pair keys and merged at all
its places, until no word has a pair left. Long words would need a round for each of their ranks over all their
symbols, so their rounds visit the places of one rank only, and look up just the pairs that a merge has made.
Finished words are kept for later batches of the task.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm import common as C

#: Words, and characters of words, kept by a task before it starts its store anew; bytes from which a word counts as long.
KEPT_WORDS, KEPT_CHARS, LONG_WORD = 150_000, 20_000_000, 256
#: Text that is encoded at once.
TEXT_BYTES = 1_000_000
NO_RANK = np.iinfo(np.int64).max


@functools.cache
def _ranges(kind: str, top: int) -> str:
    """A character class body of all code points up to top whose general category starts with kind."""
    out, begin = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(re.escape(chr(begin)) + "-" + re.escape(chr(c - 1)) if c - 1 > begin else re.escape(chr(begin)))
            begin = None
    return "".join(out)


@functools.cache
def word_pattern(top: int = 0x10FFFF) -> str:
    """The vocabulary's word pattern (fixed value: contractions, letters, one digit, the rest)."""
    letters, numbers = _ranges("L", top), _ranges("N", top)
    space = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


class Vocabulary:
    """The tables of one vocabulary file (a tokenizers JSON with a BPE model and a word-end suffix)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, vocab = d["model"], d["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for table in (vocab, self.special):
            for token, i in table.items():
                self.tokens[i] = token
        byte_chars = self._byte_chars()
        self.inner = np.array([vocab[c] for c in byte_chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in byte_chars], np.int64)
        self.n = len(self.tokens)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, np.diff(keys[order]) > 0]]
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = merged[order]
        # Merging all places of a rank at once is exact only if no merge makes a pair of a lower or equal rank.
        made = np.full(self.n, -1)
        np.maximum.at(made, merged, np.arange(len(merged)))
        if (np.maximum(made[keys // self.n], made[keys % self.n]) >= np.arange(len(keys))).any():
            raise ValueError("a merge of this vocabulary uses a symbol that a later merge makes")

    @staticmethod
    def _byte_chars() -> list[str]:
        """The printable character that stands for each byte: itself, or one of the code points from 256 on."""
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(spare)) for b in range(256)]

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if there is none) and merged symbol of pairs, by binary search over the sorted pair keys."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.merged[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the offsets of each word's ids. Words aren't empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        long_ = np.repeat(sizes >= LONG_WORD, sizes)
        parts = [self._rounds(symbols[~long_], word[~long_])]
        if long_.any():
            parts.append(self._rank_rounds(symbols[long_], word[long_]))
        symbols, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    @staticmethod
    def _alternate(linked: np.ndarray) -> np.ndarray:
        """Of places that overlap (a run of one symbol; linked: with the place before) every second one, from the left."""
        nth = np.arange(len(linked)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(linked))))
        return nth % 2 == 0

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after rounds that merge each word's lowest rank."""
        done_symbols, done_words = [symbols[:0]], [word[:0]]
        while len(symbols):
            rank, merged = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
            pair = np.flatnonzero(word[:-1] == word[1:])
            rank[pair], merged[pair] = self.found(symbols[pair], symbols[pair + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            open_ = lowest < NO_RANK
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            places = np.flatnonzero((rank == lowest) & open_)
            places = places[self._alternate(np.r_[False, np.diff(places) == 1][: len(places)])]
            symbols[places] = merged[places]
            open_[places + 1] = False
            symbols, word = symbols[open_], word[open_]
        return np.concatenate(done_symbols), np.concatenate(done_words)

    def _rank_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same after rounds that merge the lowest rank of all words at its places, which are kept by rank."""
        n = len(symbols)
        after = np.append(np.where(word[1:] == word[:-1], np.arange(1, n), -1), -1)
        before = np.append(-1, np.where(word[1:] == word[:-1], np.arange(n - 1), -1))
        rank, merged, alive = np.full(n, NO_RANK), np.zeros(n, np.int64), np.ones(n, bool)
        queue: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def look_up(places: np.ndarray) -> None:
            rank[places], merged[places] = self.found(symbols[places], symbols[after[places]])
            places = places[rank[places] < NO_RANK]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            of, first = np.unique(rank[places], return_index=True)
            for r, some in zip(of.tolist(), np.split(places, first[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(some)

        look_up(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            places = places[self._alternate(np.r_[False, after[places[:-1]] == places[1:]])]
            gone = after[places]
            symbols[places] = merged[places]
            alive[gone], rank[gone] = False, NO_RANK
            after[places] = after[gone]
            follows = after[places] >= 0
            before[after[places[follows]]] = places[follows]
            rank[places] = NO_RANK
            touched = np.unique(np.r_[places, before[places][before[places] >= 0]])
            look_up(touched[after[touched] >= 0])
        return symbols[alive], word[alive]


class Encoder:
    """Encodes whole texts; keeps the words that it has met."""

    def __init__(self, spec: str, pattern: str, bmp_pattern: str):
        self.vocabulary = Vocabulary(spec)
        self.words, self.bmp_words = re.compile(pattern).findall, re.compile(bmp_pattern).findall
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\t-\r a-zA-Z0-9]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.astral = re.compile("[\U00010000-\U0010ffff]").search
        self.restart()

    def restart(self) -> None:
        self.index: dict[str, int] = {}
        self.decoded: list[str] = []
        self.chars = 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for text, i in self.vocabulary.special.items():
            self._add([text], np.array([i], np.int32), np.array([0, 1]))

    def _add(self, words: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        self.chars += sum(map(len, words))
        self.index.update(zip(words, range(len(self.decoded), len(self.decoded) + len(words)), strict=True))
        tokens = [self.vocabulary.tokens[i] for i in ids.tolist()]
        self.decoded += [" ".join(tokens[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.at = np.concatenate([self.at, at[1:] + self.at[-1]])

    def split(self, text: str) -> list[str]:
        """The words of a text after composition and lower-casing; special strings count as words."""
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return [w for i, x in enumerate(parts) for w in ([x] if i % 2 else self.split_plain(x))]
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if text.isascii():
            # Lower-casing ASCII makes no special string out of another text: their letters are lower case,
            # and such a string would have been cut out before.
            return self.ascii_words(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.words if self.astral(text) else self.bmp_words)(text)

    def known(self, texts: list[str | None]) -> list[np.ndarray]:
        """The words of each text, as numbers of kept words."""
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split) - self.index.keys()
        if len(new) + len(self.decoded) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.restart()
            new = set().union(*split) - self.index.keys()
        if new:
            words = list(new)
            self._add(words, *self.vocabulary.encode(words))
        return [np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) for words in split]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        return np.array([(self.at[w + 1] - self.at[w]).sum() for w in self.known(texts)], np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        rows = self.known(texts)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        decoded = [" ".join(map(self.decoded.__getitem__, row.tolist())) for row in rows]
        word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        begin, length = self.at[word], self.at[word + 1] - self.at[word]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(sizes)]], decoded


def _slices(texts: pa.Array):
    """(first row, texts) of slices of about TEXT_BYTES of text."""
    rows = max(1, TEXT_BYTES * len(texts) // max(texts.nbytes, 1))
    for i in range(0, len(texts), rows):
        yield i, texts.slice(i, rows).to_pylist()


def encoder_of(path: str):
    """A function that makes an Encoder in a task; path is a vocabulary file on the driver, whose content travels with the plan."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    pattern, bmp_pattern = word_pattern(), word_pattern(0xFFFF)
    return lambda: Encoder(spec, pattern, bmp_pattern)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns keep of it; all by default) with ids (array<int>) and decoded (string) of the text column.

    ids are what the vocabulary's library gives without added special tokens, decoded is what those ids decode to. path
    is a vocabulary file on the driver; its content travels with the plan. Every row is kept, repeated rows too, and
    encoded whole, however long; null and empty texts have no ids and decode to an empty text. Columns of the new names
    are replaced. An empty table gives an empty table.
    """
    make = encoder_of(path)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    names = [f"c{i}" for i in range(len(kept))]
    sent = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in zip(kept, names, strict=True)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            for i, texts in _slices(b.column("t")):
                found, at, plain = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, len(texts)) for n in names), lists, pa.array(plain, pa.string())], [*names, "ids", "decoded"])

    out = sent.mapInArrow(encoded, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("ids").alias(ids), F.col("decoded").alias(decoded))
