"""Classes of things that are alike: groups of linked rows, tables that come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import words
from lexquarry.sources.store import release, stored


def classes(links: DataFrame) -> DataFrame:
    """node, class_id (the least node that links reach), n_links of links (u, v), each pair once in either order; every node has a link.

    In each round a node takes the least class of its neighbours, then that class's own class, so that long chains shorten by powers of two. Rounds are stored
    in the shared folder, and only the last two are kept.
    """
    both = links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct()
    edges = stored(both, "links")
    now = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(least.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = not new.where("before <> label").isEmpty()
        release(now)
        now = new
        if not changed:
            break
    return now.join(edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links")), "node").select("node", F.col("label").alias("class_id"), "n_links")


def normal(cell: Column) -> Column:
    """A cell in lower case with single spaces."""
    return F.lower(F.array_join(words(F.coalesce(cell, F.lit(""))), " "))


def fingerprint(headers: Column, rows: Column) -> Column:
    """A digest of a table that is the same whatever the order of its rows, case and white space: headers in order, then each row's digest, sorted."""
    head = F.array_join(F.transform(F.coalesce(headers, F.expr("cast(array() as array<string>)")), normal), "\x1f")
    row = lambda r: F.sha2(F.array_join(F.transform(F.coalesce(r, F.expr("cast(array() as array<string>)")), normal), "\x1f"), 256)
    return F.sha2(F.concat(head, F.lit("\x1e"), F.array_join(F.array_sort(F.transform(F.coalesce(rows, F.expr("cast(array() as array<array<string>>)")), row)), "\x1f")), 256)


def repeated_tables(tables: DataFrame) -> DataFrame:
    """table_id, class_id, n_tables of tables (table_id, headers, rows) that come more than once; class_id is the least id of those alike.

    Tables are alike if headers and rows are, but for case, white space and the order of rows. Tables without any text are left out. Counts are made before
    the shuffle, and classes go back to tables by a join, so a table that very many pages have is no task of its own.
    """
    none = F.expr("cast(array() as array<string>)")
    filled = F.exists(F.concat(F.coalesce("headers", F.expr("cast(array() as array<string>)")), F.flatten(F.transform(F.coalesce("rows", F.expr("cast(array() as array<array<string>>)")), lambda r: F.coalesce(r, none)))), lambda c: normal(c) != "")
    marked = tables.where(filled).select("table_id", fingerprint(F.col("headers"), F.col("rows")).alias("print"))
    groups = marked.groupBy("print").agg(F.min("table_id").alias("class_id"), F.count("*").alias("n_tables")).where("n_tables > 1")
    return marked.join(groups, "print").select("table_id", "class_id", "n_tables")
