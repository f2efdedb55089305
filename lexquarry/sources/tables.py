"""Readers: the given tables, the page model over documents, JSON chunk and document files, binary files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.operators.state import places

CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("chunkId", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(documents: DataFrame) -> DataFrame:
    """The page model: a source is a document, its rows by doc_id are the pages.

    Returns document_id, page_number, doc_id, text. A source's pages are counted in ranges of doc_id, so that no task
    sorts all texts of a large source.
    """
    found = documents.select(F.col("source").alias("document_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return places(found, "doc_id", ("document_id",)).select("document_id", (F.col("__at") + 1).cast("int").alias("page_number"), "doc_id", "text")


#: Bytes of a file that are read at once for its digest.
DIGEST_BYTES = 8 << 20


def digest(path: str, size: int, step: int = DIGEST_BYTES) -> str:
    """The SHA-256 of a file of any store that Arrow reads, in ranges: only one of them is held."""
    if path.startswith(("file:", "/")):
        store, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(quote(path, safe="/:@?=&"))
    running = hashlib.sha256()
    with store.open_input_file(at) as file:
        for first in range(0, size, step):
            running.update(file.read_at(min(step, size - first), first))
    return running.hexdigest()


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", most: int | None = None, step: int = DIGEST_BYTES) -> DataFrame:
    """path, length and sha256 of files below path, sorted by path; hidden, lock and empty files are skipped.

    Spark lists the files and spreads them over tasks; a task reads a file in ranges of step bytes, so files may be of any size.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = found.where(~name.startswith(".") & ~name.startswith("~$")).select("path", "length").orderBy("path")
    found = found.limit(most) if most is not None else found

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (p, n) in enumerate(zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([digest(p, n, step)])], ["path", "length", "sha256"])

    return found.mapInArrow(hashed, "path string, length bigint, sha256 string")


def parsed(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[dict[str, Any]]]], pattern: str = "*.pdf") -> DataFrame:
    """path, parser, fault, and a row for each page (page_number, raw_text, images) of files below path, by the first parser that gives a page with text.

    A parser maps a file's bytes to pages (dicts with raw_text and images); each file is one task's work. Where one fails or finds no
    text the next is tried. A file that none can read has one row with the last fault.
    """
    names = ["path", "parser", "fault", "page_number", "raw_text", "images"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for at, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                fault, found = "no text", None
                for name, parse in parsers.items():
                    try:
                        pages = parse(content)
                    except Exception as e:  # a parser's own faults, whatever they are, hand the file on
                        fault = f"{name}: {type(e).__name__}"
                        continue
                    if any((p.get("raw_text") or "").strip() for p in pages):
                        found = [(at, name, None, k, p.get("raw_text"), p.get("images", 0)) for k, p in enumerate(pages, 1)]
                        break
                rows += found or [(at, None, fault, None, None, None)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return read.select("path", "content").mapInArrow(run, "path string, parser string, fault string, page_number int, raw_text string, images int")


def filled(*columns: Column) -> Column:
    """The first of columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, text, metadata, file of JSON chunk files: a list, or an object with a list under chunks.

    Ids may be named chunk_id, id or chunkId, texts text, content or chunk; items without either are skipped, and so
    are files that don't parse.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    listed = F.from_json("value", T.ArrayType(CHUNK))
    wrapped = F.from_json("value", T.StructType([T.StructField("chunks", T.ArrayType(CHUNK))]))["chunks"]
    items = raw.select("file", F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped)).alias("c")).where("c is not null")
    found = items.select(filled(F.col("c.chunk_id"), F.col("c.id"), F.col("c.chunkId")).alias("chunk_id"), filled(F.col("c.text"), F.col("c.content"), F.col("c.chunk")).alias("text"), F.col("c.metadata").alias("metadata"), "file")
    return found.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())


PAGE = "page_number int, citation_label string, raw_text string, structured_text string, cleaned_text string, tables array<struct<table_id:string,headers:array<string>,rows:array<array<string>>,caption:string>>, figures array<struct<figure_id:string,image_path:string,caption:string,width:int,height:int>>"
DOCUMENT = f"document_id string, category string, file_path string, pages array<struct<{', '.join(f'{name}:{kind}' for name, kind in (c.split(' ', 1) for c in PAGE.split(', ')))}>>"


def structured(documents: DataFrame, json: str = "value") -> DataFrame:
    """document_id, category, file_path and PAGE: a row for each page of documents held as JSON in a column; broken ones have none."""
    read = documents.select(F.from_json(json, DOCUMENT).alias("d")).where("d.pages is not null")
    return read.select("d.document_id", "d.category", "d.file_path", F.explode("d.pages").alias("p")).select("document_id", "category", "file_path", "p.*")


def structured_files(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """structured() of the files {category}/{document}/{document}_structured.json below path; only names the documents to read."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_structured.json").text(path)
    found = raw.select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
    found = found if only is None else found.where(F.col("folder").isin(*only))
    return structured(found)


def qrels(answers: DataFrame, json: str = "value") -> DataFrame:
    """query_id, chunk_id of ground truth held as JSON in a column: a list of ids for each query, or an object with relevant_chunks."""
    read = answers.select(F.explode(F.from_json(json, "map<string, string>")).alias("query_id", "x"))
    listed = F.when(F.col("x").startswith("["), F.from_json("x", "array<string>")).otherwise(F.from_json("x", "relevant_chunks array<string>")["relevant_chunks"])
    return read.select("query_id", F.explode(listed).alias("chunk_id")).distinct()


def embedded(vectors: DataFrame, metadata: DataFrame, key: list[str]) -> DataFrame:
    """vectors with their metadata by key; vectors without metadata, and metadata without a vector, are passed over."""
    return vectors.join(metadata, key)


def to_run(files: DataFrame, pilot: DataFrame) -> DataFrame:
    """files (path, length, sha256) that no pilot (sha256) had, and how many files have the same content."""
    rest = files.join(pilot.select("sha256").distinct(), "sha256", "left_anti")
    return rest.join(rest.groupBy("sha256").agg((F.count("*") - 1).alias("n_peers"), F.min("path").alias("first_path")), "sha256")


ENTRY = "struct<category:string,relative_path:string,expected_pages:bigint,actual_pages:bigint,file_size_bytes:bigint,sha256_hash:string,duplicate_of:array<string>>"


def manifest_inventory(manifests: DataFrame, scanned: DataFrame, pilot: DataFrame, json: str = "value") -> DataFrame:
    """folder, document_id, category, relative_path, expected_pages, file_size_bytes, sha256_hash, duplicate_of, from_manifest of documents to clean.

    manifests (folder, value: JSON with an object of entries by document id under documents) say which documents a folder holds; where a folder's manifest is missing,
    broken or empty, those that a scan found count (scanned: folder, document_id, category, n_pages, size). Documents of pilot (document_id) are left out of both.
    """
    read = manifests.select("folder", F.from_json(json, f"documents map<string,{ENTRY}>")["documents"].alias("m")).where(F.size("m") > 0)
    listed = read.select("folder", F.explode("m").alias("document_id", "e"))
    path = lambda given: F.coalesce(given, F.concat(F.lit("documents/"), "document_id", F.lit(".pdf")))
    of = listed.select("folder", "document_id", F.coalesce("e.category", F.lit("root")).alias("category"), path(F.col("e.relative_path")).alias("relative_path"), F.coalesce("e.expected_pages", "e.actual_pages", F.lit(0)).alias("expected_pages"), F.coalesce("e.file_size_bytes", F.lit(0)).alias("file_size_bytes"), F.coalesce("e.sha256_hash", F.lit("")).alias("sha256_hash"), F.coalesce("e.duplicate_of", F.expr("cast(array() as array<string>)")).alias("duplicate_of"), F.lit(True).alias("from_manifest"))
    rest = scanned.join(read.select("folder").distinct(), "folder", "left_anti")
    found = rest.select("folder", "document_id", "category", path(F.lit(None).cast("string")).alias("relative_path"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("expected_pages"), F.col("size").cast("long").alias("file_size_bytes"), F.lit("").alias("sha256_hash"), F.expr("cast(array() as array<string>)").alias("duplicate_of"), F.lit(False).alias("from_manifest"))
    return of.union(found).join(pilot.select("document_id").distinct(), "document_id", "left_anti")


def category_and_id(path: Column) -> tuple[Column, Column]:
    """(folder name, file name without extension) of a path."""
    parts = F.split(path, "/")
    return F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
