"""Registered queries: what parsers find, as page records and figures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.operators import figures as G
from lexquarry.operators import items as I
from lexquarry.sources.tables import table

LABELS = ["Title", "text", "list_item", "table", "picture", "page_heading", "section_header"]


def _items(spark, sf):
    """Each line of all documents as an item, by turns of each label, ten a page; every tenth has no page."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("k"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    n = F.col("seq") % len(LABELS)
    cell = lambda r, c, rs, cs, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(rs).alias("row_span"), F.lit(cs).alias("column_span"), t.alias("text"))
    cells = F.array(cell(0, 0, 1, 2, F.lit("H")), cell(1, 0, 2, 1, F.col("text")), cell(1, 1, 1, 1, F.lit("x")))
    return d.select(
        "document_id",
        "seq",
        F.element_at(F.array(*map(F.lit, LABELS)), n + 1).alias("label"),
        "text",
        (F.col("seq") % 8).alias("level"),
        F.when(F.col("seq") % 10 != 9, F.floor(F.col("seq") / 10) + 1).alias("page_no"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("Figure "), F.col("k").cast("string"))).alias("caption"),
        F.when((n == 3) & (F.col("k") % 2 == 0), cells).alias("cells"),
    )


def layout_pages(spark, sf):
    made = I.page_records(_items(spark, sf))
    return made.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.sha2("structured_text", 256).alias("text_sha256"), F.size("blocks").cast("long").alias("n_blocks"), F.size("section_headings").cast("long").alias("n_headings"), F.concat_ws(",", "tables.table_id").alias("tables"), F.concat_ws(",", "figures.figure_id").alias("figures"))


def layout_blocks(spark, sf):
    b = I.blocks(_items(spark, sf))
    return b.select("document_id", F.col("page_number").cast("long").alias("page_number"), "block_id", "kind", F.col("heading_level").cast("long").alias("heading_level"), F.sha2("text", 256).alias("text_sha256"))


def png(width: int, height: int, values: int) -> bytes:
    """A picture of diagonal stripes of so many grey values, its data stored without compression."""
    x = ((np.arange(width)[None, :] + np.arange(height)[:, None]) % values * 5).astype(np.uint8)
    raw = np.column_stack([np.zeros(height, np.uint8), np.repeat(x, 3, axis=1)]).tobytes()
    parts = [raw[k : k + 65535] for k in range(0, len(raw), 65535)]
    data = b"\x78\x01" + b"".join(struct.pack("<BHH", k == len(parts) - 1, len(p), len(p) ^ 0xFFFF) + p for k, p in enumerate(parts)) + struct.pack(">I", zlib.adler32(raw))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def _drawn(*sizes: Column) -> Column:
    @F.arrow_udf("binary")
    def drawn(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for w, h, v in batches:
            yield pa.array([png(*x) for x in zip(w.to_pylist(), h.to_pylist(), v.to_pylist(), strict=True)], pa.binary())

    return drawn(*sizes)


def figure_assets(spark, sf):
    """A picture for each part, five a page, read back from its bytes; every 17th is cut off within its header."""
    k = F.col("p_partkey")
    width, height, values = (k * 37 % 180 + 1).cast("int"), (k * 61 % 120 + 1).cast("int"), (k % 23 + 1).cast("int")
    content = F.when(k % 17 == 0, F.substring(_drawn(width, height, values), 1, 20)).otherwise(_drawn(width, height, values))
    images = table(spark, sf, "part").select(F.lit("d").alias("document_id"), F.floor(k / 5).alias("page_number"), k.alias("seq"), (k % 90).cast("double").alias("left"), content.alias("content"))
    found = G.figures(images)
    return found.select("page_number", "figure_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("n_values").cast("long").alias("n_values"), F.col("size").cast("long").alias("size"), "caption", "keep", "reason")


QUERIES = {f.__name__: f for f in (layout_pages, layout_blocks, figure_assets)}

_LAYOUT = f"""
  i AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id AS k, seq - 1 AS seq, ls[seq] AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(seq)),
  j AS (SELECT *, {LABELS!r}[seq % {len(LABELS)} + 1] AS label, CASE WHEN seq % 10 = 9 THEN 1 ELSE seq // 10 + 1 END AS page_number, replace(raw, '|', '\\|') AS cell FROM i),
  l AS (SELECT *, CASE WHEN label IN ('Title', 'page_heading') THEN 'heading' WHEN label = 'table' THEN 'table' WHEN label = 'picture' THEN 'figure' WHEN label = 'list_item' THEN 'list_item' ELSE 'paragraph' END AS kind FROM j),
  b AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY seq) - 1 AS o, row_number() OVER (PARTITION BY document_id, page_number, kind ORDER BY seq) AS nk,
    CASE WHEN kind = 'heading' THEN CASE WHEN seq % 8 = 0 THEN 1 ELSE seq % 8 END END AS heading_level,
    CASE WHEN kind = 'table' AND k % 2 = 0 THEN '| H | H |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || cell || ' | x |' || chr(10) || '| ' || cell || ' |  |'
      WHEN kind = 'figure' THEN CASE WHEN k % 3 = 0 THEN 'Figure ' || k WHEN raw <> '' THEN raw ELSE '[Figure on Page ' || page_number || ']' END ELSE raw END AS text FROM l),
  s AS (SELECT *, CASE kind WHEN 'heading' THEN repeat('#', CAST(least(heading_level + 1, 6) AS INT)) || ' ' || text WHEN 'list_item' THEN '- ' || text WHEN 'figure' THEN NULL ELSE text END AS line FROM b)"""

SQL = {
    "layout_blocks": f"WITH {_LAYOUT} SELECT document_id, page_number, 'p' || page_number || '_b' || o AS block_id, kind, heading_level, sha256(text) AS text_sha256 FROM s",
    "layout_pages": f"""WITH {_LAYOUT}, p AS (SELECT document_id, unnest(range(1, max(page_number) + 1)) AS page_number FROM s GROUP BY document_id),
      g AS (SELECT document_id, page_number, string_agg(line, chr(10) || chr(10) ORDER BY o) AS t, count(*) AS n, count(*) FILTER (kind = 'heading') AS h,
        string_agg('table_p' || page_number || '_' || nk, ',' ORDER BY o) FILTER (kind = 'table') AS tables, string_agg('fig_p' || page_number || '_' || nk, ',' ORDER BY o) FILTER (kind = 'figure') AS figures FROM s GROUP BY ALL)
      SELECT document_id, page_number, sha256(coalesce(t, '')) AS text_sha256, coalesce(n, 0) AS n_blocks, coalesce(h, 0) AS n_headings, coalesce(tables, '') AS tables, coalesce(figures, '') AS figures FROM p LEFT JOIN g USING (document_id, page_number)""",
    "figure_assets": """WITH f AS (SELECT p_partkey AS k, p_partkey // 5 AS page_number, p_partkey * 37 % 180 + 1 AS w, p_partkey * 61 % 120 + 1 AS h, p_partkey % 23 + 1 AS v, p_partkey % 90 AS l, p_partkey % 17 = 0 AS cut FROM part),
      z AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY k) AS n, h * (3 * w + 1) AS raw FROM f),
      m AS (SELECT *, CASE WHEN cut THEN 20 ELSE 63 + raw + 5 * ((raw + 65534) // 65535) END AS size, CASE WHEN cut THEN 0 ELSE w END AS a, CASE WHEN cut THEN 0 ELSE h END AS b, CASE WHEN cut THEN 0 ELSE least(v, w + h - 1) END AS c FROM z WHERE cut OR NOT (w < 40 AND h < 40)),
      r AS (SELECT *, CASE WHEN least(a, b) > 0 THEN round(greatest(a, b) / least(a, b), 2) ELSE 999 END AS x FROM m),
      d AS (SELECT *, CASE WHEN cut THEN 'file_missing_or_unreadable' WHEN c <= 1 THEN 'solid_color_mask_zero_variance' WHEN l < 30 AND x > 8 THEN 'decorative_margin_bar' WHEN x > 8 THEN 'extreme_aspect_ratio_hairline'
        WHEN (a < 40 OR b < 40) AND c >= 8 THEN 'preserved_small_security_symbol' WHEN a < 40 OR b < 40 THEN 'sub_dimension_decorative_icon' WHEN size < 1000 AND c >= 8 THEN 'preserved_small_rich_symbol' WHEN size < 1000 THEN 'file_size_under_1000_bytes' ELSE 'retained_genuine_visual_diagram' END AS reason FROM r)
      SELECT page_number, 'fig_p' || page_number || '_' || n AS figure_id, CASE WHEN NOT cut THEN w END AS width, CASE WHEN NOT cut THEN h END AS height, CASE WHEN NOT cut THEN c END AS n_values, size,
        'Embedded image (' || k || ', ' || a || 'x' || b || ')' AS caption, reason LIKE 'preserved%' OR reason LIKE 'retained%' AS keep, reason FROM d""",
}
