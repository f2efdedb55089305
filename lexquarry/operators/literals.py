"""Which texts hold which of many literals, by one automaton for all of them.

The literals' bytes make a trie, whose failure links are folded into a table of the next state by state and class of byte. Texts are cut into pieces that
overlap by the longest literal, and all pieces of a batch step through the table together, a byte at a time: a step is one look-up for every piece.
A text is read once however many literals there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import words

#: Entries of a table (four bytes each) at most: literals that need more are searched in parts. Bytes of a piece, and of a batch's texts.
CELLS, PIECE, BATCH_BYTES = 16_000_000, 1024, 8 << 20


@dataclass(frozen=True)
class Automaton:
    """next[state * n_classes + class], the class of each byte, the literal that ends in a state (-1 for none), the next shorter state in
    which one ends (0 for none), whether any ends there, and the longest literal's length."""

    next: np.ndarray
    classes: np.ndarray
    literal: np.ndarray
    shorter: np.ndarray
    ends: np.ndarray
    longest: int


def built(literals: list[bytes]) -> Automaton:
    """The automaton of literals that are neither empty nor repeated."""
    used = np.unique(np.frombuffer(b"".join(literals), np.uint8))
    classes = np.zeros(256, np.int64)  # class 0 is of bytes that no literal has
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    children: list[dict[int, int]] = [{}]
    ending: dict[int, int] = {}
    for number, literal in enumerate(literals):
        state = 0
        for c in classes[np.frombuffer(literal, np.uint8)].tolist():
            state_children = children[state]
            if c not in state_children:
                state_children[c] = len(children)
                children.append({})
            state = state_children[c]
        ending[state] = number
    n = len(children)
    table, fail = np.zeros((n, width), np.int32), np.zeros(n, np.int32)
    literal_of, shorter = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    literal_of[list(ending)] = list(ending.values())
    level = [0]
    while level:  # by depth, so that the table of a state's failure is there before it
        deeper = []
        for state in level:
            row = table[fail[state]].copy() if state else np.zeros(width, np.int32)
            for c, child in children[state].items():
                fail[child] = row[c]
                row[c] = child
                deeper.append(child)
            table[state] = row
            shorter[state] = fail[state] if literal_of[fail[state]] >= 0 else shorter[fail[state]]
        level = deeper
    return Automaton(table.ravel(), classes, literal_of, shorter, (literal_of >= 0) | (shorter > 0), max(map(len, literals)))


def found(a: Automaton, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and literal, each once; texts are raw[at[i]:at[i + 1]]."""
    lengths, step = np.diff(at), max(PIECE, 2 * a.longest)
    pieces = -(-lengths // step)
    text = np.repeat(np.arange(len(lengths)), pieces)
    begin = at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
    end = np.minimum(begin + step + a.longest - 1, at[1:][text])
    order = np.argsort(begin - end, kind="stable")  # longest first: those still running are the first so many
    text, begin, end = text[order], begin[order], end[order]
    size = end - begin
    running = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    classes, width = a.classes[raw], len(a.next) // len(a.literal)
    state, hits = np.zeros(len(text), np.int64), []
    for k, n in enumerate(running.tolist()):
        state[:n] = a.next[state[:n] * width + classes[begin[:n] + k]]
        some = np.flatnonzero(a.ends[state[:n]])
        if len(some):
            hits.append(text[some] * len(a.literal) + state[some])
    both = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    text, state = np.divmod(both, len(a.literal))
    pairs = []
    while len(state):
        ends = a.literal[state] >= 0
        pairs.append(text[ends] * len(a.literal) + a.literal[state[ends]])
        more = a.shorter[state] > 0
        text, state = text[more], a.shorter[state[more]].astype(np.int64)
    return np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), len(a.literal))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _parts(literals: list[bytes], cells: int) -> Iterator[list[bytes]]:
    """Literals in order, cut where a part's bytes times its different bytes would pass the bound; a part has one literal at least."""
    held, size, used = [], 1, set()
    for x in literals:
        more = used | set(x)
        if held and (size + len(x)) * (len(more) + 1) > cells:
            yield held
            held, size, more = [], 1, set(x)
        held.append(x)
        size, used = size + len(x), more
    if held:
        yield held


def counts(docs: DataFrame, literals: DataFrame, cells: int = CELLS) -> DataFrame:
    """item_id, n_docs: rows of docs (text) that hold a literal (item_id, text) whole; runs of white space are one space.

    Different literals come to the driver, which makes the automaton that each task gets; sorted by their beginnings and cut into parts where a table would pass
    cells entries, each of which reads the texts once. A null or blank literal is in every row. Null texts are empty.
    """
    plain = lambda c: F.array_join(words(F.coalesce(c, F.lit(""))), " ")
    wanted = literals.select("item_id", plain(F.col("text")).alias("literal"))
    bodies = docs.select(plain(F.col("text")).alias("body"))
    spark, counted = docs.sparkSession, None
    different = sorted(r["literal"].encode() for r in wanted.where("literal <> ''").select("literal").distinct().collect())
    for part in _parts(different, cells):
        sent = spark.sparkContext.broadcast((built(part), part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton, names = sent.value
            n = np.zeros(len(names), np.int64)
            for b in batches:
                raw, at = _flat(b.column("body"))
                i = 0
                while i < b.num_rows:
                    j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
                    _, literal = found(automaton, raw[at[i] : at[j]], at[i : j + 1] - at[i])
                    n += np.bincount(literal, minlength=len(names))
                    i = j
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([names[k].decode() for k in some], pa.string()), pa.array(n[some])], ["literal", "n"])

        each = bodies.mapInArrow(run, "literal string, n bigint")
        counted = each if counted is None else counted.union(each)
    n_all = F.broadcast(docs.agg(F.count("*").alias("n_all")))  # one row
    if counted is None:
        return wanted.crossJoin(n_all).select("item_id", F.col("n_all").alias("n_docs"))
    sums = counted.groupBy("literal").agg(F.sum("n").alias("n"))
    return wanted.join(sums, "literal", "left").crossJoin(n_all).select("item_id", F.when(F.col("literal") == "", F.col("n_all")).otherwise(F.coalesce("n", F.lit(0))).alias("n_docs"))
