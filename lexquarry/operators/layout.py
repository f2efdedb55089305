"""Layout blocks, page and document assessment, exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import strip, white
from lexquarry.operators import quality as Q

#: Limits of heading blocks.
SHORT_BLOCK, LONG_HEADING = 120, 160
SECTION = white(r"(?i)^(SECTION|[0-9]+(\.[0-9]+)*|[A-Z]\.[0-9]+)\s+")
ITEM = white(r"^([•\-*]|[0-9]+\.|\([a-z0-9]+\))\s+")

DIGEST = pa.schema([("document_id", pa.string()), ("n_pages", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string())])


def block_kind(text: Column) -> Column:
    """struct (kind, level) of a stripped block: heading (level 2 with a section number, else 3), list_item or paragraph."""
    lines = F.split(text, "\n")
    first = strip(F.get(lines, F.lit(0)))
    section = first.rlike(SECTION)
    capitals = (F.upper(first) == first) & (F.lower(first) != first)
    short = (F.length(text) < SHORT_BLOCK) & (F.size(lines) <= 2)
    head = (short & (capitals | section)) | (section & (F.length(text) < LONG_HEADING))
    level = F.when(head, F.when(section, 2).otherwise(3))
    return F.struct(F.when(head, "heading").when(first.rlike(ITEM), "list_item").otherwise("paragraph").alias("kind"), level.alias("level"))


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """page, block_id, reading_order, kind, level, text, section_title of blocks (page, left, top, text): from top to bottom, then left to right.

    Blank blocks are left out but keep their number; the title is the last heading so far.
    """
    by_place = Window.partitionBy("page").orderBy("top", "left", "text")
    numbered = blocks.withColumn("reading_order", F.row_number().over(by_place)).withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("b", block_kind(F.col("text")))
    so_far = Window.partitionBy("page").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("b.kind") == "heading", F.col("text")), True).over(so_far)
    return numbered.select("page", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("reading_order").cast("string")).alias("block_id"), "reading_order", "b.kind", "b.level", "text", title.alias("section_title"))


def structured_text(blocks: DataFrame) -> DataFrame:
    """page, text: blocks in reading order as Markdown, headings with their level's marks, items with a dash."""
    shown = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(2))), F.lit(" "), "text")).when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return blocks.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", shown.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def with_dividers(pages: DataFrame) -> DataFrame:
    """document_id, page_number, text: pages (document_id, page_number, text), each under its divider."""
    one = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return pages.select("document_id", "page_number", one.alias("text"))


def digests(divided: DataFrame) -> DataFrame:
    """document_id, n_pages, n_chars, digest of each document's pages (document_id, page_number, text) joined by line feeds.

    The digest is a sum over pages of the first 60 bits of the SHA-256 of a page's number and text: it tells the same pages in the same
    order from all others, and parts of a document are summed wherever they lie, so that no task reads a whole one.
    """
    bits = F.conv(F.left(F.sha2(F.concat(F.col("page_number").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), F.lit(15)), 16, 10).cast("decimal(20,0)")
    chars = F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count("*") - 1
    return divided.groupBy("document_id").agg(F.count("*").alias("n_pages"), chars.alias("n_chars"), F.sum(bits).cast("string").alias("digest"))


def text_digests(divided: DataFrame) -> DataFrame:
    """document_id, n_pages, n_chars, text_sha256 of each document's whole text: its pages (document_id, page_number, text) in order, joined by line feeds.

    Pages stay rows: a task reads a document's pages in order and holds a batch of them and the running hash, never the whole text.
    A document is one task's work, as a SHA-256 can only be taken in order; digests tells texts apart without that.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda *row: pa.RecordBatch.from_pydict(dict(zip(DIGEST.names, ([x] for x in row), strict=True)), DIGEST)
        doc, n_pages, n_chars, running = None, 0, 0, None
        for b in batches:
            for d, n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if running is not None and d == doc:
                    running.update(b"\n")
                    n_chars += 1
                else:
                    if running is not None:
                        yield out(doc, n_pages, n_chars, running.hexdigest())
                    doc, n_pages, n_chars, running = d, 0, 0, hashlib.sha256()
                running.update(text.as_buffer())
                n_pages += 1
                n_chars += n
        if running is not None:
            yield out(doc, n_pages, n_chars, running.hexdigest())

    text = F.coalesce("text", F.lit(""))
    in_order = divided.select("document_id", "page_number", text.alias("text")).repartition("document_id").sortWithinPartitions("document_id", "page_number", "text")
    return in_order.select("document_id", F.length("text").cast("long").alias("n_chars"), F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "document_id string, n_pages bigint, n_chars bigint, text_sha256 string")


def standalone_tables(page_text: Column, tables: Column) -> Column:
    """Those of a page's tables (array of Markdown) for which the text has no occurrence left: the n-th of equal ones needs n."""
    seen = lambda m, i: F.size(F.filter(F.slice(tables, F.lit(1), i + 1), lambda x: x == m))
    found = lambda m: (F.length(page_text) - F.length(F.replace(page_text, m, F.lit("")))) / F.length(m)
    marked = F.transform(tables, lambda m, i: F.struct(m.alias("m"), (seen(m, i) > found(m)).alias("alone")))
    return F.transform(F.filter(marked, lambda x: x["alone"]), lambda x: x["m"])


def assessment(raw: Column, structured: Column, figures: Column, n_table_issues: Column, out_of_order: Column | None = None) -> Column:
    """Warning categories of a page, in order; an empty page has no other. out_of_order: whether order_anomalies has found the page."""
    a, b = F.length(strip(raw)), F.length(strip(structured))
    apart = F.abs(a - b) / F.greatest(a, b)
    signs = Q.garbled(F.when(a > 0, raw).otherwise(structured))
    found = F.concat(
        F.array_compact(F.array(F.when((a > 0) & (a < Q.LOW_TEXT), "low_text_page"), F.when((a < Q.OCR_TEXT) & (figures > 0), "ocr_candidate"), F.when(F.size(signs) > 0, "garbled_text"))),
        F.array_repeat(F.lit("table_irregularity"), n_table_issues.cast("int")),
        F.array_compact(F.array(F.when(F.lit(False) if out_of_order is None else out_of_order, "reading_order_warning"), F.when((a > 200) & (b > 0) & (apart > 0.40), "representation_divergence"))),
    )
    return F.when((a == 0) & (b == 0), F.array(F.lit("empty_page"))).otherwise(found)


def document_assessment(pages: DataFrame) -> DataFrame:
    """Documents from pages (document_id, found, existing: arrays of categories): counts over both, and the document's own warnings.

    A category that a page has already is not added to it again.
    """
    both = F.concat("existing", F.filter("found", lambda c: ~F.array_contains("existing", c)))
    n = lambda kind: F.sum(F.size(F.filter("both", lambda c: c == kind)))
    counted = pages.withColumn("both", both).groupBy("document_id").agg(F.count("*").alias("n_pages"), n("empty_page").alias("n_empty"), n("ocr_candidate").alias("n_ocr"), n("garbled_text").alias("n_garbled"), n("table_irregularity").alias("n_table"))
    own = F.array_compact(F.array(F.when((F.col("n_empty") > 0) & (F.col("n_empty") == F.col("n_pages")), "all_pages_empty"), F.when(F.col("n_ocr") > 0, "document_has_ocr_candidates"), F.when(F.col("n_garbled") > 0, "document_has_garbled_pages")))
    return counted.withColumn("warnings", F.array_join(own, ","))


def corrected(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text) with guarded corrections (document_id, page_number, signature, pattern, replacement) and applied.

    A rule holds for its page if the text has the signature and not yet the replacement. There may be a rule for every
    document: the join is Spark's choice.
    """
    r = rules.withColumnsRenamed({"document_id": "__d", "page_number": "__p"})
    held = pages.join(r, (F.col("document_id") == F.col("__d")) & (F.col("page_number") == F.col("__p")), "left")
    holds = F.coalesce(F.contains("text", "signature") & ~F.contains("text", "replacement"), F.lit(False))
    return held.withColumn("applied", holds).withColumn("text", F.when(holds, F.expr("replace(text, pattern, replacement)")).otherwise(F.col("text"))).select(*pages.columns, "applied")


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """First fault of each document between two stages (document_id, page_number, text): pages missing or not consecutive, text lost."""
    shape = lambda df, n: df.groupBy("document_id").agg(F.count("*").alias(f"{n}_pages"), (F.max("page_number") - F.min("page_number") + 1).alias(f"{n}_span"), F.sum(F.length("text")).alias(f"{n}_chars"))
    both = shape(before, "b").join(shape(after, "a"), "document_id", "left")
    fault = F.coalesce(F.when(F.col("a_pages").isNull(), "missing"), F.when(F.col("a_pages") != F.col("b_pages"), "page_count"), F.when(F.col("a_span") != F.col("a_pages"), "not_consecutive"), F.when((F.col("a_chars") / F.greatest("b_chars", F.lit(1))).between(0.85, 1.30), "").otherwise("text_ratio"))
    return both.select("document_id", fault.alias("fault"))
