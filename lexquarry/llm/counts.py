"""Token counts as delta-maintained rollups.

Changes of documents are signed: an insert adds a document and its count, a delete takes both away, and a
revision takes the old count away and adds the new one. A batch of changes is summed to one row for each source,
language and tokenizer version, and written aside under a name of its own. What commits it is a mark under the batch's
number that names those deltas and that only one writer can make. Totals are the sums of all deltas that a mark
names. A batch that comes again, after a lost executor, from a driver that was started anew or from a second writer,
finds its mark and changes nothing.
"""

from __future__ import annotations

import base64
import contextlib
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe
from lexquarry.llm import common as C

KEYS = ["source", "lang", "version"]
DELTAS = "source string, lang string, version string, docs bigint, tokens bigint"
#: Bytes of text that are counted at once.
PIECE_BYTES = 1_000_000
#: Held while a mark is renamed: a store whose rename looks first and then renames is safe for the writers of one driver at least.
RENAMING = threading.Lock()


def counted(docs: DataFrame, versions: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, with one long column of token counts for each version (columns of those names are replaced).

    versions names a vocabulary file for each: one that bpe.Encoder reads (.json), or byte ranks (.tiktoken), whose words
    pattern finds. Whole texts are counted, strings of special tokens by what the file's kind makes of them; null and
    empty texts have none. Every row is kept; an empty table gives an empty table.
    """
    makers = {}
    for name, path in versions.items():
        if path.endswith(".json"):
            makers[name] = (lambda make: lambda: make().counts)(bpe.encoder_of(path))
        else:
            with open(path, "rb") as f:
                makers[name] = (lambda lines: lambda: _by_ranks(lines, pattern))(f.read())
    kept = [c for c in docs.columns if c not in (*versions, text)]
    names = [f"c{i}" for i in range(len(kept))]
    sent = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, names, strict=True)), *(f"v{k} bigint" for k in range(len(makers)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [make() for make in makers.values()]
        for b in batches:
            rows = max(1, PIECE_BYTES * b.num_rows // max(b.column("t").nbytes, 1))
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                texts = part.column("t").to_pylist()
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(c(texts), pa.int64()) for c in counters)], [*names, *(f"v{k}" for k in range(len(counters)))])

    out = sent.mapInArrow(count, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], *[F.col(f"v{k}").alias(v) for k, v in enumerate(makers)])


def _by_ranks(lines: bytes, pattern: str):
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [len(encode(t)) if t else 0 for t in texts]


def deltas(changes: DataFrame) -> DataFrame:
    """DELTAS of changes (change_id, op, source, lang, version, tokens, old_tokens).

    op is insert (tokens), delete (old_tokens) or revise (old_tokens, tokens); others change nothing. A change_id that
    comes several times counts once, with the least of its rows where they differ; null ones are changes of their own. Null
    counts are zero. Null keys are a group of their own. Sums are combined before the shuffle, so a hot source is no hot task.
    """
    row = F.struct("op", *KEYS, F.col("tokens").cast("long").alias("tokens"), F.col("old_tokens").cast("long").alias("old_tokens"))
    named = changes.where(F.col("change_id").isNotNull()).groupBy("change_id").agg(F.min(row).alias("row"))
    each = named.select("row.*").unionByName(changes.where(F.col("change_id").isNull()).select(row.alias("row")).select("row.*"))
    op = F.col("op")
    added = F.when(op.isin("insert", "revise"), F.coalesce("tokens", F.lit(0))).otherwise(0)
    taken = F.when(op.isin("delete", "revise"), F.coalesce("old_tokens", F.lit(0))).otherwise(0)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    sums = each.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(added - taken).cast("long").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


class Rollup:
    """Deltas below path/deltas, and the marks of committed batches below path/batches, on a store that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def committed(self, batch: int) -> bool:
        return self._fs.exists(self._at(f"batches/{batch}"))

    def _mark(self, batch: int, name: str) -> bool:
        """Makes the batch's mark, which holds name; False if there is one already.

        The mark is written aside, whole, and then linked or renamed, which fails where the target exists: one call of
        the store, so that of any number of writers one gets True. A rename need be atomic only between drivers.
        """
        aside, mark = self._at(f"_aside/{name}"), self._at(f"batches/{batch}")
        out = self._fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        self._fs.mkdirs(self._at("batches"))
        try:
            if self._fs.getScheme() == "file":
                # A local rename replaces its target; a hard link does not.
                local = [self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0)) for p in (mark, aside)]
                self._jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                with RENAMING:
                    context.rename(aside, mark, options)
            return True
        except Exception:
            if not self.committed(batch):
                raise
            return False
        finally:
            with contextlib.suppress(Exception):
                self._fs.delete(aside, False)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing is added, if a batch of that number is committed already."""
        if self.committed(batch):
            return False
        name = uuid.uuid4().hex
        deltas(changes).coalesce(1).write.parquet(f"{self.path}/deltas/name={name}")
        done = False
        try:
            done = self._mark(batch, name)
        finally:
            if not done:
                self._fs.delete(self._at(f"deltas/name={name}"), True)
        return done

    def log(self) -> DataFrame:
        """All committed deltas, with their batch; no rows before the first commit."""
        if not self._fs.exists(self._at("batches")):
            return self.spark.createDataFrame([], DELTAS + ", batch int")
        marks = self.spark.read.text(f"{self.path}/batches").select(F.col("value").alias("name"), F.col("_metadata.file_name").cast("int").alias("batch"))
        written = self.spark.read.schema(DELTAS + ", name string").parquet(f"{self.path}/deltas")
        return written.join(C.small_or_not(marks), "name").select(*DELTAS.replace(" string", "").replace(" bigint", "").split(", "), "batch")

    def totals(self) -> DataFrame:
        """DELTAS summed over all batches; groups without documents and tokens are left out."""
        sums = self.log().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def maintained(rollup: Rollup, docs: DataFrame, withdrawn: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """Totals of docs (doc_id, text, source, lang, n_chars) by two tokenizer versions, after four batches, one of which comes twice.

    Batch 1 inserts every row with an estimate (a quarter of n_chars, rounded up) as its count by the first version; batch 2 revises
    all of them to the counts of the whole texts, and comes again; batch 3 inserts counts by the second version; batch 4 deletes
    rows whose doc_id is in withdrawn, in both versions. Rows that repeat an id are rows of their own; null ids are never withdrawn.
    Each text is counted once; the counts are stored.
    """
    first, second = versions
    named = docs.select("doc_id", "source", "lang", F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).cast("long").alias("estimate"), "text")
    keyed = C.stored(counted(named, versions, pattern), "counted")

    def change(frame: DataFrame, op: str, version: str, tokens: Column, old: Column) -> DataFrame:
        return frame.select(F.lit(None).cast("string").alias("change_id"), F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), tokens.alias("tokens"), old.alias("old_tokens"))

    none, by_first, by_second = F.lit(0).cast("long"), F.col(f"`{first}`"), F.col(f"`{second}`")
    rollup.commit(1, change(keyed, "insert", first, F.col("estimate"), none))
    revised = change(keyed, "revise", first, by_first, F.col("estimate"))
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    rollup.commit(3, change(keyed, "insert", second, by_second, none))
    gone = keyed.join(withdrawn.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    rollup.commit(4, change(gone, "delete", first, none, by_first).unionByName(change(gone, "delete", second, none, by_second)))
    C.release(keyed)
    return rollup.totals()
