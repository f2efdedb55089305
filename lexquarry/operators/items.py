"""Items of a layout parser to page records: blocks, tables with their grids, figures, headings and structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an item's label has to contain to become a block of a kind, in this order.
KINDS = [("heading", ("heading", "title")), ("table", ("table",)), ("figure", ("picture", "figure")), ("list_item", ("list",))]
DEEPEST, STATUS = 6, "EXTRACTED_VLM_PENDING"


def kind_of(label: Column) -> Column:
    low, out = F.lower(F.coalesce(label, F.lit(""))), F.lit("paragraph")
    for kind, words in reversed(KINDS):
        test = low.contains(words[0])
        for w in words[1:]:
            test = test | low.contains(w)
        out = F.when(test, kind).otherwise(out)
    return out


def grids(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, n_rows, n_columns, markdown of tables whose cells (key, row, column, row_span, column_span, text) may span several places.

    A cell fills all places that it spans; where two fill the same place that of the smaller row and column stands, and places without a cell are empty.
    Spans that are null or under 1 count as 1. The first row is the header. Bars in texts are escaped, line breaks become spaces.
    """
    span = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    text = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", " ")
    placed = cells.select(*key, F.struct("row", "column").alias("at"), text.alias("text"), F.col("column"), span(F.col("column_span")).alias("wide"), F.explode(F.sequence(F.col("row"), F.col("row") + span(F.col("row_span")) - 1)).alias("r"))
    placed = placed.select(*key, "at", "text", "r", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("wide") - 1)).alias("c"))
    one = placed.groupBy(*key, "r", "c").agg(F.min_by("text", "at").alias("text"))
    rows = one.groupBy(*key, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("of"), F.max("c").alias("last"))
    whole = rows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("r", "of"))).alias("of"), F.max("r").alias("last_row"), F.max("last").alias("last_column"))
    columns = F.sequence(F.lit(0), F.col("last_column"))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    row = lambda r: line(F.transform(columns, lambda c: F.coalesce(F.try_element_at(F.try_element_at("of", r), c), F.lit(""))))
    lines = F.transform(F.sequence(F.lit(0), F.col("last_row")), row)
    rule = line(F.transform(columns, lambda c: F.lit("---")))
    markdown = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")
    return whole.select(*key, (F.col("last_row") + 1).alias("n_rows"), (F.col("last_column") + 1).alias("n_columns"), markdown.alias("markdown"))


def blocks(items: DataFrame) -> DataFrame:
    """document_id, page_number, block_id, reading_order, kind, text, heading_level, n_of_kind, line, n_rows, n_columns of items.

    items (document_id, seq, label, text, level, page_no, caption, cells: array of structs row, column, row_span, column_span, text). Items without a
    page stand on page 1. A table's text is its grid in Markdown, or the item's own without cells; a figure's is its caption, or
    its text, or a mark. line is what the block adds to the page's structured text; figures add nothing.
    """
    kind, text = kind_of(F.col("label")), F.coalesce("text", F.lit(""))
    page = F.coalesce("page_no", F.lit(1)).cast("int")
    base = items.select("document_id", "seq", page.alias("page_number"), kind.alias("kind"), text.alias("text"), F.nullif("level", F.lit(0)).alias("level"), "caption")
    cells = items.where((kind == "table") & (F.size("cells") > 0)).select("document_id", "seq", F.inline("cells"))
    joined = base.join(grids(cells, ["document_id", "seq"]), ["document_id", "seq"], "left")
    of_page, of_kind = Window.partitionBy("document_id", "page_number").orderBy("seq"), Window.partitionBy("document_id", "page_number", "kind").orderBy("seq")
    order, number = F.row_number().over(of_page) - 1, F.row_number().over(of_kind)
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("text", F.lit("")), F.concat(F.lit("[Figure on Page "), F.col("page_number").cast("string"), F.lit("]")))
    shown = F.when(F.col("kind") == "table", F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"))).when(F.col("kind") == "figure", caption).otherwise(F.col("text"))
    level = F.when(F.col("kind") == "heading", F.coalesce("level", F.lit(1)).cast("int"))
    numbered = joined.select("document_id", "page_number", order.alias("reading_order"), "kind", shown.alias("text"), level.alias("heading_level"), number.alias("n_of_kind"), "n_rows", "n_columns")
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("heading_level") + 1, F.lit(DEEPEST))), F.lit(" "), "text")).when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text")).when(F.col("kind") != "figure", F.col("text"))
    name = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_b"), F.col("reading_order").cast("string"))
    return numbered.select("document_id", "page_number", name.alias("block_id"), "reading_order", "kind", "text", "heading_level", "n_of_kind", line.alias("line"), "n_rows", "n_columns")


def page_records(items: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """document_id, page_number, citation_label, structured_text, section_headings, blocks, tables, figures: a row for each page of items' documents.

    Pages run from 1 to a document's number of pages (document_id, n_pages), or without one to its last item's; pages without items are empty ones.
    """
    b = blocks(items)
    page = F.col("page_number").cast("string")
    of = lambda kind, *fields: F.when(F.col("kind") == kind, F.struct("reading_order", *fields))
    name = lambda stem: F.concat(F.lit(stem), page, F.lit("_"), F.col("n_of_kind").cast("string"))
    gathered = b.groupBy("document_id", "page_number").agg(
        F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "kind", "text", "heading_level"))).alias("blocks"),
        F.array_sort(F.collect_list(F.struct("reading_order", "line"))).alias("lines"),
        F.array_sort(F.collect_list(of("table", name("table_p").alias("table_id"), F.col("text").alias("markdown"), "n_rows", "n_columns"))).alias("tables"),
        F.array_sort(F.collect_list(of("figure", name("fig_p").alias("figure_id"), F.col("text").alias("caption"), F.lit(STATUS).alias("status")))).alias("figures"),
    )
    ends = b.groupBy("document_id").agg(F.max("page_number").alias("last"))
    if page_counts is not None:
        ends = ends.join(page_counts.select("document_id", "n_pages"), "document_id", "full").select("document_id", F.coalesce("n_pages", "last", F.lit(1)).cast("int").alias("last"))
    every = ends.select("document_id", F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("page_number"))
    joined = every.join(gathered, ["document_id", "page_number"], "left")
    lines = F.transform(F.filter("lines", lambda x: x["line"].isNotNull()), lambda x: x["line"])
    headings = F.transform(F.filter("blocks", lambda x: x["kind"] == "heading"), lambda x: x["text"])
    label = F.concat(F.lit("["), "document_id", F.lit(" Page "), page, F.lit("]"))
    return joined.select(
        "document_id",
        "page_number",
        label.alias("citation_label"),
        F.coalesce(F.array_join(lines, "\n\n"), F.lit("")).alias("structured_text"),
        F.coalesce(headings, F.expr("cast(array() as array<string>)")).alias("section_headings"),
        F.coalesce("blocks", F.expr("cast(array() as array<struct<reading_order:int,block_id:string,kind:string,text:string,heading_level:int>>)")).alias("blocks"),
        F.coalesce("tables", F.expr("cast(array() as array<struct<reading_order:int,table_id:string,markdown:string,n_rows:int,n_columns:int>>)")).alias("tables"),
        F.coalesce("figures", F.expr("cast(array() as array<struct<reading_order:int,figure_id:string,caption:string,status:string>>)")).alias("figures"),
    )
