"""Writers: artifacts by category, manifests, vectors with upserts, guards against overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """df with arrays of strings joined, for CSV."""
    return df.select(*[F.array_join(c, ";").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def write(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, overwrite: bool = False) -> None:
    """Writes df; an existing folder is an error unless overwrite. Spark's commit leaves all files or none."""
    writer = (flat(df) if form == "csv" else df).write.mode("overwrite" if overwrite else "errorifexists").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_artifacts(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """Artifacts of documents (document_id, category, markdown, raw_text, pages: array of structs), each form in a folder of its own by category.

    structured holds JSON, markdown and raw_text a row of text for each document, manifest one JSON row of counts for each category.
    """
    write(documents.select("document_id", "category", "pages"), f"{path}/structured", "json", ["category"], overwrite)
    for form in ("markdown", "raw_text"):
        write(documents.select("document_id", "category", form), f"{path}/{form}", "parquet", ["category"], overwrite)
    counts = documents.groupBy("category").agg(F.count("*").alias("n_documents"), F.sum(F.size("pages")).alias("n_pages"), F.sum(F.length("raw_text")).alias("n_chars"))
    write(counts, f"{path}/manifest", "json", None, overwrite)


def manifest(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks and tokens."""
    return chunks.agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


def upsert(points: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of points (point_id, ...) to a collection; the same batch again replaces itself."""
    points.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def points(spark: SparkSession, path: str) -> DataFrame:
    """The collection: of each point_id the row of its last batch."""
    last = Window.partitionBy("point_id").orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "batch")


def verify(vectors: DataFrame, metadata: DataFrame, key: str) -> dict[str, int]:
    """Counts of both sides and of keys that one of them lacks."""
    a, b = vectors.select(key).distinct(), metadata.select(key).distinct()
    return {"vectors": vectors.count(), "metadata": metadata.count(), "without_metadata": a.join(b, key, "left_anti").count(), "without_vector": b.join(a, key, "left_anti").count()}


def add_embeddings(vectors: DataFrame, path: str, run: str) -> None:
    """Adds the vectors of a run with their metadata; the same run again replaces itself, so a run that was cut off can be repeated."""
    vectors.write.mode("overwrite").parquet(f"{path}/run={run}")


def add_statuses(events: DataFrame, path: str) -> None:
    """Appends status events (key, status, at); state.latest and state.rollup read the manifest's view from them."""
    events.write.mode("append").parquet(path)


def rolled_up(manifests: DataFrame) -> DataFrame:
    """One row of sums over manifests (n_documents, n_chunks, n_tokens), and how many there are."""
    return manifests.agg(F.count("*").alias("n_manifests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_documents", "n_chunks", "n_tokens")])
