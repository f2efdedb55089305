"""Figures from the bytes of images: kind and size from headers, sample values from what can be decoded, and which are worth keeping."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators.quality import figure_decision

#: Both sides of an icon are under ICON; status of a figure that waits for its description.
ICON, STATUS = 40, "EXTRACTED_VLM_PENDING"
#: Pixels that are decoded at most; of a larger image the size is known, not its samples.
MOST_PIXELS = 64_000_000
RESULT = "struct<kind:string,width:int,height:int,n_values:int>"
#: JPEG markers of frames, which hold the size.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) of a PNG, GIF, BMP or JPEG; None for anything else, or where the header is cut off."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return "bmp", width, abs(height)
        if data[:2] == b"\xff\xd8":
            at = 2
            while True:
                while data[at] == 0xFF and data[at + 1] == 0xFF:
                    at += 1
                marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if data[at] != 0xFF:
                    return None
                if marker in FRAMES:
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", width, height
                at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        length = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        at += 12 + length


def _unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG's bytes with their filters undone; step is the number of bytes of a pixel."""
    out, before = np.empty_like(raw), np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = raw[y]
        if kind == 1:
            width = -(-len(row) // step) * step
            row = np.cumsum(np.pad(row, (0, width - len(row))).reshape(-1, step), 0, dtype=np.uint8).ravel()[: len(row)]
        elif kind == 2:
            row = row + before
        elif kind in (3, 4):
            done = [0] * step
            above, corner = before.tolist(), [0] * step + before.tolist()
            for x, v in enumerate(row.tolist()):
                a, b, c = done[x], above[x], corner[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done.append((v + guess) & 255)
            row = np.array(done[step:], np.uint8)
        elif kind:
            raise ValueError("an unknown filter")
        out[y] = before = row
    return out


def png_values(data: bytes) -> int | None:
    """How many different bytes the samples of a PNG hold (those of its palette's colours where it has one); None for interlaced ones."""
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if interlaced or width * height > MOST_PIXELS:
        return None
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts[name] = parts.get(name, b"") + body
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    per_row = -(-width * channels * depth // 8)
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)[: height * (per_row + 1)].reshape(height, per_row + 1)
    plain = _unfiltered(rows[:, 1:], rows[:, 0], max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(plain, axis=1).reshape(height, -1, depth)[:, :width]
        plain = np.packbits(bits, axis=2, bitorder="big")[:, :, 0] >> (8 - depth)
        plain = plain if color == 3 else (plain.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        plain = plain[:, ::2]
    if color == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        plain = palette[np.unique(plain)]
    return len(np.unique(plain))


def _measured(data: bytes | None) -> tuple[str | None, int | None, int | None, int | None]:
    found = size_of(data) if data else None
    if found is None:
        return None, None, None, None
    try:
        return *found, png_values(data) if found[0] == "png" else None
    except (struct.error, KeyError, IndexError, ValueError, zlib.error):  # a broken image still has a size
        return *found, None


def measured(content: Column) -> Column:
    """struct<kind, width, height, n_values> of an image's bytes; all null for what is no image, n_values for what isn't decoded (anything but PNG)."""

    @F.arrow_udf(RESULT)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            columns = list(zip(*(_measured(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b), strict=True)) or [(), (), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["kind", "width", "height", "n_values"])

    return read(content)


def figures(images: DataFrame) -> DataFrame:
    """document_id, page_number, figure_id, kind, width, height, caption, status, keep, reason of images (document_id, page_number, seq, content, left).

    Images of a page are numbered by seq from 1; those of which both sides are under ICON are left out but keep their number. keep and reason
    are figure_decision's, by the image's bytes, sides, place and sample values. What is no image has no sides and stays, to be discarded by its reason.
    """
    number = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("seq"))
    seen = images.select("document_id", "page_number", "seq", "left", F.octet_length("content").alias("size"), measured(F.col("content")).alias("m"))
    numbered = seen.withColumn("figure_id", F.concat(F.lit("fig_p"), F.col("page_number").cast("string"), F.lit("_"), number.cast("string")))
    large = numbered.where(F.col("m.width").isNull() | ~((F.col("m.width") < ICON) & (F.col("m.height") < ICON)))
    width, height = F.coalesce("m.width", F.lit(0)), F.coalesce("m.height", F.lit(0))
    decided = figure_decision(F.when(F.col("m.kind").isNotNull(), F.col("size")), width, height, F.coalesce("left", F.lit(999.0)), F.coalesce("m.n_values", F.lit(0)))
    caption = F.concat(F.lit("Embedded image ("), F.col("seq").cast("string"), F.lit(", "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))
    return large.select("document_id", "page_number", "figure_id", "m.kind", "m.width", "m.height", "m.n_values", "size", caption.alias("caption"), F.lit(STATUS).alias("status"), decided.alias("d")).select("*", "d.keep", "d.reason").drop("d")
