"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins. Training goes round the features in turn and adds
one shallow tree (up to three leaves over one feature's bins) to that feature's table; then the pairs
that explain most of what is left get tables of two binned features, grown by depth-two trees in the
same way. A text's score is the logistic function of the sum of its bins' entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import common as C

FEATURES = ["log_bytes", "letters", "upper", "digits", "space", "bars", "symbols", "shouts", "stops", "word_bytes", "repeats", "distinct_words", "distinct_lines", "line_words"]
BINS, PAIR_BINS, PAIRS = 32, 8, 6
SLICE_BYTES = 1_000_000


def _classes() -> np.ndarray:
    """Byte classes: 0 other symbols, 1 letters (all non-ASCII bytes too), 2 digits, 3 space, 4 '|', 5 '!?', 6 '.,;:', 7 upper case, 8 quiet marks."""
    out = np.zeros(256, np.int64)
    out[[*range(97, 123), *range(128, 256)]], out[[*range(48, 58)]], out[[*b" \t\r\n\x0b\x0c"]] = 1, 2, 3
    out[[*b"|"]], out[[*b"!?"]], out[[*b".,;:"]], out[[*range(65, 91)]], out[[*b"'\"()-"]] = 4, 5, 6, 7, 8
    return out


CLASSES = _classes()
IN_WORD = CLASSES != 3
BY_BYTE = C.fixed_random(256, 6)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct values of each row."""
    if not len(row):
        return np.zeros(rows)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
    return np.bincount(row[new], minlength=rows).astype(float)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all zero for an empty one."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(row * 9 + CLASSES[raw], minlength=9 * n).reshape(n, 9).astype(float)
    start, end, of = C.word_spans(raw, at, IN_WORD)
    words = np.bincount(of, minlength=n).astype(float)
    hashes = C.span_hashes(raw, start, end, BY_BYTE)
    same = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
    repeats = np.bincount(of[1:][same], minlength=n)
    line_start, line_end, line_of = C.word_spans(raw, at, np.arange(256) != 10)
    lines = np.bincount(line_of, minlength=n).astype(float)
    one = lambda x: np.maximum(x, 1)
    letters = counts[:, 1] + counts[:, 7]
    solid = size - counts[:, 3]
    return np.column_stack([
        np.log1p(size), letters / one(solid), counts[:, 7] / one(letters), counts[:, 2] / one(solid), counts[:, 3] / one(size), counts[:, 4] / one(words), counts[:, 0] / one(words), counts[:, 5] / one(words), counts[:, 6] / one(words),
        solid / one(words), repeats / one(words), _distinct(of, hashes, n) / one(words), _distinct(line_of, C.span_hashes(raw, line_start, line_end, BY_BYTE), n) / one(lines), np.log1p(words / one(lines)),
    ])


def of_texts(texts: pa.Array) -> np.ndarray:
    raw, at = C.flat(texts)
    parts = [features(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in C.slices(at, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """The fitted model: bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += entries[np.searchsorted(edges, x[:, f], "right")]
        for a, b, entries in self.pairs:
            total += entries[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between bins, each halfway between two seen values, so that near values share a bin."""
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    above = np.sort(x)[np.minimum(np.searchsorted(np.sort(x), cuts, "right"), len(x) - 1)]
    return np.unique((cuts + above)[above > cuts] / 2)


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree over one binned feature, split greedily where the gain is largest."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (i, j) in enumerate(parts):
            if j - i < 2:
                continue
            gl, hl = np.cumsum(g[i:j])[:-1], np.cumsum(h[i:j])[:-1]
            gt, ht = g[i:j].sum(), h[i:j].sum()
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            if gain.max() > best[0]:
                best = (gain.max(), k, i + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        i, j = parts.pop(best[1])
        parts += [(i, best[2]), (best[2], j)]
    out = np.zeros(len(g))
    for i, j in parts:
        out[i:j] = _leaf(g[i:j].sum(), h[i:j].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values by bin pair of a depth-two tree (first feature, then the second in either half), and its gain."""
    best, out = 0.0, np.zeros(g.shape)
    for cut in range(1, g.shape[0]):
        value, gain = np.zeros(g.shape), 0.0
        for half in (slice(0, cut), slice(cut, None)):
            gs, hs = g[half].sum(0), h[half].sum(0)
            tree = _tree(gs, hs, ridge, 2)
            value[half] = tree
            gain += float((2 * tree * gs - tree**2 * hs).sum())
        if gain > best:
            best, out = gain, value
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 20, rate: float = 0.15, ridge: float = 2.0) -> Additive:
    """Fits the tables to labels 0/1. Without rows every score is 0.5; with one label it is that label's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    k = x.shape[1]
    model.edges, model.coarse = [_quantiles(x[:, f], BINS) for f in range(k)], [_quantiles(x[:, f], PAIR_BINS) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    total = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = residual()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n), ridge)
            model.tables[f] += step
            total += step[bins[f]]

    def histogram(a: int, b: int, w: np.ndarray) -> np.ndarray:
        na, nb = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(coarse[a] * nb + coarse[b], w, na * nb).reshape(na, nb)

    g, h = residual()
    gains = sorted(((_pair_tree(histogram(a, b, g), histogram(a, b, h), ridge)[1], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, entries in model.pairs:
            g, h = residual()
            step = rate * _pair_tree(histogram(a, b, g), histogram(a, b, h), ridge)[0]
            entries += step
            total += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Additive:
    """Fits a model on at most max_rows labelled rows that aren't held out, chosen by a hash of the id.

    Ids that are null, labels other than 0 and 1, and labels without a document are passed over; where an
    id has several labels, their mean decides (0.5 or more is 1). Only features of at most max_rows rows reach the driver.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~C.held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds the broadcast
    # Ids may repeat: of all their rows max_rows are taken, in a fixed order.
    rows = rows.withColumn("th", F.xxhash64("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = of_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("th"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], ["doc_id", "label", "th", "x"])

    got = rows.mapInArrow(featured, "doc_id bigint, label int, th bigint, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["label"].to_numpy(float))


def score(model: Additive, text: Column) -> Column:
    """The model's score, 0 to 1, of each whole text. Null counts as empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(model.score(of_texts(b)), pa.float64())

    return scored(text)


def classify(docs: DataFrame, model: Additive, threshold: float = 0.7, text: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score and a prediction (1 from threshold on) for each row; columns of those names are replaced.

    Every row is kept and scored on its own whole text, null and empty texts too. Nothing but the text
    enters a score. An empty table gives an empty table.
    """
    return docs.withColumn(score_col, score(model, F.col(text))).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
