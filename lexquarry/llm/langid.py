"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. The letters of a text are
compressed with every dictionary, and the language whose dictionary gives the fewest bytes is chosen; the margin to
the next one gives the score, and narrow margins are marked as rejected. A dictionary is out of reach once a frame is
longer than the window, so long texts are compressed in pieces, each a fresh frame, and the bytes of all pieces count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm import common as C

#: Bounds of the training sample: rows of each language, characters learned from a row, dictionary bytes of each language.
ROWS_PER_LANG, ROW_CHARS, DICT_BYTES = 80, 20_000, 200_000
#: Bytes of letters in a frame at most, well under the window of 2**WINDOW_LOG.
WINDOW_LOG, PIECE_BYTES = 18, 1 << 16
RESULT = "struct<lang:string,score:double,margin:double>"
LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """The letters of a text in lower case, other characters as single spaces; empty without a letter."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def train(docs: DataFrame, rows: int = ROWS_PER_LANG, row_chars: int = ROW_CHARS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, most frequent language first, from the rows with the smallest hashes.

    Rows that are held out, and those with a null id, text or lang, are passed over. Of a text of more than row_chars
    characters the row_chars from a place that its hash chooses are learned. At most rows texts of a language reach
    the driver; together they fill up to size bytes.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~C.held_out(F.col("doc_id")))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - row_chars, F.lit(0)) + 1).cast("int") + 1
    pieces = known.select("lang", F.xxhash64("doc_id").alias("place"), "doc_id", F.when(F.length("text") <= row_chars, F.col("text")).otherwise(F.substring(F.col("text"), start, F.lit(row_chars))).alias("piece"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    often = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    texts: dict[str, list[bytes]] = {lang: [] for lang in sorted(often, key=lambda x: (-often[x], x))}
    for r in ranked.collect():
        texts[r["lang"]].append(plain(r["piece"]))
    return {lang: b" ".join(sorted(found))[:size] for lang, found in texts.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.langs = list(dictionaries)
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(level, window_log=WINDOW_LOG, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes by language, summed over pieces of about equal length that together are all of data."""
        n = max(1, -(-len(data) // PIECE_BYTES))
        step = max(1, -(-len(data) // n))
        pieces = [data[k : k + step] for k in range(0, len(data), step)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        letters = plain(text) if text and self.langs else b""
        if not letters:
            return "und", 0.0, 0.0
        sizes = self.sizes(letters)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = order[0]
        if len(order) == 1:
            return self.langs[best], 1.0, 1.0
        margin = (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        return self.langs[best], float(1 - np.exp(-20 * margin)), float(margin)


def identify(dictionaries: dict[str, bytes], text: Column) -> Column:
    """struct<lang, score, margin>: the language whose dictionary compresses the whole text best.

    lang is 'und' with score 0 for null texts, texts without a letter, and when no language was learned; on equal
    sizes the language learned from more rows wins with score 0. margin is the saving over the second best, as a share.
    """

    @F.arrow_udf(RESULT)
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(dictionaries)
        for b in batches:
            found = [classifier(t) for t in b.to_pylist()]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["lang", "score", "margin"])

    return identified(text)


def identify_documents(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.02, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (the margin is under narrow, or the language is 'und').

    Every row is kept; columns of those names are replaced. Only the text enters a prediction. An empty
    table gives an empty table.
    """
    (found,) = C.fresh(docs, "found")
    out = docs.withColumn(found, identify(dictionaries, F.col(text)))
    return out.withColumn("lang_pred", F.col(found)["lang"]).withColumn("score", F.col(found)["score"]).withColumn("rejected", F.col(found)["margin"] < narrow).drop(found)
