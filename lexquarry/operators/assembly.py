"""Parts of documents put together: parser outputs, spliced tables, Markdown, chunks of all kinds, warnings, issue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import let, strip
from lexquarry.operators import chunking as K
from lexquarry.operators import tables as T

#: Bytes of stored output a page, and what stands for a figure's description where no model is at hand.
PAGE_BYTES, DIAGRAM_STATUS = 43_296.7, "vlm_unavailable"
ROOT = ["documents", "root"]
LOST = "\ufffd"


def warnings(given: Column, text: Column, page: Column) -> Column:
    """Distinct warnings of a page as strings, sorted: given ones (structs of type and desc; without desc the type alone), and one for lost characters."""
    named = F.transform(given, lambda w: F.concat_ws(": ", F.coalesce(w["type"], F.lit("ENCODING_WARNING")), w["desc"]))
    lost = F.when(text.contains(LOST), F.array(F.concat(F.lit("Contains \\ufffd on page "), page.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(named, F.array().cast("array<string>")), lost)))


def root_category(category: Column, folder: Column) -> Column:
    """A document's category: 'root' for documents that lie in the root folder, else its own, or the folder's."""
    own = F.coalesce(category, folder)
    return F.when(own.isin(*ROOT) | F.coalesce(folder == "root", F.lit(False)), "root").otherwise(own)


def without_tables(text: Column, tables: Column) -> Column:
    """A page's text without the Markdown of its tables (array of strings); blank ones take nothing away."""
    solid = F.filter(F.transform(tables, strip), lambda m: m != "")
    return F.aggregate(solid, F.coalesce(text, F.lit("")), lambda rest, m: F.replace(rest, m, F.lit("")))


def spliced(text: Column, tables: Column, boxes: Column) -> Column:
    """A text in which each box (array of structs start, end) has given way to the table (array of Markdown) of its place among them.

    Boxes are taken from the last start to the first. A box without a table, or whose range isn't one of the text as it is by then, stays as it is. Tables
    follow at the end if there are no boxes at all, and only then. Null arrays count as empty.
    """
    gap, none = F.lit("\n\n"), F.expr("cast(array() as array<struct<start:int,end:int>>)")
    tables, boxes = F.coalesce(tables, F.expr("cast(array() as array<string>)")), F.coalesce(boxes, none)
    last_first = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-F.coalesce(b["start"], F.lit(0))).cast("int").alias("from_end"), i.alias("i"), b["start"].cast("int").alias("start"), b["end"].cast("int").alias("end"))))
    placed = F.transform(last_first, lambda b, i: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.get(tables, F.size(boxes) - 1 - i).alias("table")))

    def put(rest: Column, b: Column) -> Column:
        fits = (b["start"] >= 0) & (b["start"] < b["end"]) & (b["end"] <= F.length(rest)) & b["table"].isNotNull()
        return F.when(fits, F.concat(F.substring(rest, F.lit(1), b["start"]), gap, b["table"], gap, F.substring(rest, b["end"] + 1, F.length(rest)))).otherwise(rest)

    text = F.coalesce(text, F.lit(""))
    return F.when(F.size(boxes) > 0, F.aggregate(placed, text, put)).when(F.size(tables) > 0, F.concat(text, gap, F.array_join(tables, "\n\n"))).otherwise(text)


def first_parsed(*outputs: Column) -> Column:
    """struct (parser, text): the first output (struct of parser, text) of a chain of parsers that is neither missing nor blank; null if none is."""
    return F.coalesce(*[F.when(strip(o["text"]) != "", o) for o in outputs])


def document_markdown(pages: DataFrame) -> DataFrame:
    """document_id, markdown of pages (document_id, page_number, text, standalone: array of table Markdown): a heading each, text, then tables that the text lacks."""
    body = F.concat_ws("\n\n", F.concat(F.lit("## Page "), F.col("page_number").cast("string")), F.nullif(strip(F.col("text")), F.lit("")), F.nullif(F.array_join("standalone", "\n\n"), F.lit("")))
    each = F.array_sort(F.collect_list(F.struct("page_number", body.alias("body"))))
    return pages.groupBy("document_id").agg(F.concat(F.lit("# "), "document_id", F.lit("\n\n"), F.array_join(F.transform(each, lambda x: x["body"]), "\n\n")).alias("markdown"))


def figure_chunks(figures: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks of figures (document_id, page_number, seq, figure_id, image_path, caption, page_text): one each, whose asset may be missing.

    assets (path) are the files that exist. Returns chunk_id, document_id, content_type, page_start, page_end, section_heading, text,
    token_count, status, caption_linked, missing.
    """
    label = F.format_string("[%s Page %d]", F.col("document_id"), F.col("page_number"))
    known = assets.select(F.col("path").alias("image_path"), F.lit(True).alias("__there")).distinct()
    found = figures.join(known, "image_path", "left").withColumn("c", T.caption(F.col("caption"), F.col("page_text"), F.col("page_number")))
    context = T.figure_context(F.col("c.caption"), F.col("page_text"))
    lines = lambda said: F.concat_ws("\n", F.concat(F.lit("### Figure: "), F.col("c.caption")), F.concat(F.lit("Source: "), label), F.concat(F.lit("Asset: "), F.coalesce("image_path", F.lit(""))), F.when(said != "", F.concat(F.lit("Context: "), said)))
    text = found.withColumn("text", let(context, lambda said: strip(lines(said))))
    return text.select(
        F.format_string("%s_fig_%05d", "document_id", "seq").alias("chunk_id"), "document_id", F.lit("figure").alias("content_type"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"),
        F.col("c.caption").alias("section_heading"), "text", K.tokens(F.col("text")).alias("token_count"), F.lit(DIAGRAM_STATUS).alias("status"), F.col("c.linked").alias("caption_linked"), F.col("__there").isNull().alias("missing"),
    )


def all_chunks(text: DataFrame, tables: DataFrame, figures: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """Chunks of all kinds under each other, columns that a kind lacks null; with twins (document_id, duplicate_of) their known duplicates."""
    parts = [df if "content_type" in df.columns else df.withColumn("content_type", F.lit(kind)) for df, kind in ((text, "text"), (tables, "table"), (figures, "figure"))]
    both = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return both if twins is None else both.join(twins.groupBy("document_id").agg(F.sort_array(F.collect_set("duplicate_of")).alias("duplicate_of")), "document_id", "left")


def issue_records(pages: DataFrame) -> DataFrame:
    """A row for each issue of cleaned pages (document_id, page_number, cleaning): issue_type, severity and how often."""
    of = lambda kind, severity, n: F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))
    c = lambda name: F.col(f"cleaning.{name}")
    issues = F.array(of("RUNNING_HEADER_REMOVAL", "INFO", F.when(c("header").isNotNull(), 1).otherwise(0)), of("FOOTER_REMOVAL", "INFO", F.when(c("footer").isNotNull(), 1).otherwise(0)), of("HYPHEN_REPAIR", "INFO", c("n_joined")), of("AMBIGUOUS_PRESERVED", "WARNING", c("n_warnings")), of("ENCODING_TRANSFORM", "INFO", c("n_transforms")))
    return pages.select("document_id", "page_number", F.explode(F.filter(issues, lambda x: x["n"] > 0)).alias("x")).select("document_id", "page_number", "x.*")


def storage_estimate(n_pages: Column) -> Column:
    """Bytes that the outputs of so many pages take."""
    return F.round(n_pages * PAGE_BYTES).cast("long")


def checked(df: DataFrame, fault: Column, fail_fast: bool) -> DataFrame:
    """df with fault (a message, or null): with fail_fast the first one ends the run, without it the rows go on with their message."""
    return df.withColumn("fault", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(None).cast("string")) if fail_fast else fault)


def resolved_id(*ids: Column) -> Column:
    """The first id that is not null; a row without one is an error."""
    return F.coalesce(*ids, F.raise_error(F.lit("a chunk has none of its id columns")))


def first_fault(checks: dict[str, Column]) -> Column:
    """The name of the first expectation that does not hold (a null one does not), in the order given; empty if all do."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in checks.items()], F.lit(""))


def artifact_checks(expected_pages: Column, pages: Column, ids: Column, raw: Column, structured: Column, citations: Column, missing_figures: Column, ragged_rows: Column) -> dict[str, Column]:
    """Expectations of a document's artifacts for first_fault.

    pages and ids are arrays of page numbers and of the document ids that pages name, citations the pages' labels; raw is the text with page
    dividers, structured without; the last two count figure files that are missing and table rows of odd width.
    """
    n = F.size(pages)
    return {
        "page_count": n == expected_pages,
        "not_consecutive": (n > 0) & (F.array_max(pages) - F.array_min(pages) + 1 == n) & (F.size(F.array_distinct(pages)) == n),
        "document_ids": F.size(F.array_distinct(ids)) == 1,
        "dividers": F.regexp_count(raw, F.lit(r"(?m)^--- PAGE [0-9]+ ---$")) == n,
        "citations": F.forall(F.zip_with(pages, citations, lambda p, c: F.contains(c, F.concat(F.lit("Page "), p.cast("string")))), lambda holds: holds),
        "figure_files": missing_figures == 0,
        "table_rows": ragged_rows == 0,
        "text_ratio": (F.length(structured) / F.greatest(F.length(raw), F.lit(1))).between(0.85, 1.30),
    }
