"""Registered queries: document trees and a keyed collection, written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.sources.collection import Collection
from lexquarry.sources.store import scratch
from lexquarry.sources.tables import table
from lexquarry.sources.trees import read_tree, write_tree

#: Rows of the documents and of the matrices that the trees hold.
PAGES, VECTORS = 50, 200


def tree_documents(spark, sf):
    """All documents as JSON files of up to 50 pages in folders by language, read as a tree and parsed."""
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("category"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / PAGES)).alias("document"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pages = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    path = scratch(spark, "tree")
    write_tree(d.groupBy("category", "document").agg(F.to_json(F.struct(pages.alias("pages"))).alias("value")), path)
    read = read_tree(spark, path).select("category", "document", F.explode(F.from_json("value", "pages array<struct<doc_id:bigint,text:string>>")["pages"]).alias("p"))
    return read.select("category", "document", "p.doc_id", F.sha2("p.text", 256).alias("text_sha256"))


def tree_vectors(spark, sf):
    """All vectors as matrices of up to 200 rows in .npy files with a JSON list beside each, in folders by label, read as a tree."""
    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    made = v.select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("category"), F.concat(F.lit("m"), F.floor(F.col("vec_id") / VECTORS)).alias("document"), F.col("vec_id").alias("position"), "embedding", F.create_map(F.lit("vec_id"), F.col("vec_id").cast("string")).alias("metadata"))
    path = scratch(spark, "tree")
    write_tree(made, path, "vectors")
    read = read_tree(spark, path, "vectors")
    sums = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select(F.col("metadata.vec_id").cast("long").alias("vec_id"), "category", "document", "position", F.size("embedding").cast("long").alias("dims"), F.round(sums, 6).alias("total"))


def _collected(spark, sf) -> Collection:
    """Vectors of all rows in two batches that overlap, one of them committed twice, with others taken away, compacted in between."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label")
    c = Collection(spark, scratch(spark, "collection"))
    c.upsert(v.withColumn("version", F.lit(1)), "first")
    c.compact("base")
    again = v.where("point_id % 3 = 0").withColumn("version", F.lit(2))
    c.upsert(again, "second")
    c.upsert(again.withColumn("version", F.lit(9)), "second")
    c.delete(v.where("point_id % 5 = 0"), "gone")
    c.upsert(v.where("point_id % 10 = 0").withColumn("version", F.lit(3)), "third")
    return c


def vector_collection(spark, sf):
    return _collected(spark, sf).read().select("point_id", "label", "version", F.size("embedding").cast("long").alias("dims"))


def collection_report(spark, sf) -> DataFrame:
    """Numbers of the collection before and after its parts are put together."""
    c = _collected(spark, sf)
    first = c.verify()
    c.compact("again")
    rows = [(name, found["rows"], found["without_vector"], found["lengths"]) for name, found in (("before", first), ("after", c.verify()))]
    return spark.createDataFrame(rows, "state string, n_rows bigint, n_without_vector bigint, n_lengths bigint")


QUERIES = {f.__name__: f for f in (tree_documents, tree_vectors, vector_collection, collection_report)}

_KEPT = """k AS (SELECT vec_id AS point_id, label, embedding, CASE WHEN vec_id % 10 = 0 THEN 3 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0)"""
SQL = {
    "tree_documents": f"SELECT coalesce(lang, 'none') AS category, 'd' || (doc_id // {PAGES}) AS document, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "tree_vectors": f"""SELECT vec_id, category, document, row_number() OVER (PARTITION BY category, document ORDER BY vec_id) - 1 AS position, CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total
      FROM (SELECT *, coalesce(CAST(label AS VARCHAR), 'none') AS category, 'm' || (vec_id // {VECTORS}) AS document FROM embeddings WHERE embedding IS NOT NULL)""",
    "vector_collection": f"WITH {_KEPT} SELECT point_id, label, version, CAST(len(embedding) AS BIGINT) AS dims FROM k",
    "collection_report": f"WITH {_KEPT} SELECT state, count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_without_vector, count(DISTINCT len(embedding)) AS n_lengths FROM k, (SELECT unnest(['before', 'after']) AS state) GROUP BY state",
}
