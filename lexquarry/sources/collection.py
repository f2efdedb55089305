"""A keyed collection of rows (vectors with their payload) that is upserted, deleted from, compacted and read in parts of its keys.

A collection is a folder of runs and a log. A run holds rows in order of key, cut into parts of bounded size, and the log says which parts there
are, each with its least and greatest key, its number of rows and the batch that wrote it. The base has each key once; batches of
upserts and tombstones follow it. A reader merges only base parts whose keys some later part touches, so a collection that has
just been compacted is read without a shuffle, and one with a few late batches almost so.

Each batch is one entry of the log under the batch's name. An entry is made by one call of the store that fails if the entry exists, so a batch that is
repeated, or written by two writers at once, counts once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.sources.store import Marks, stored

#: Rows of a part.
PART_ROWS = 1_000_000
BASE, UPSERT, DELETE = "base", "upsert", "delete"


@dataclass(frozen=True)
class Part:
    run: str
    part: int
    kind: str
    low: object
    high: object
    rows: int
    order: int


class Collection:
    """A collection below path, whose rows are told apart by column key (of a type that JSON can hold and that orders)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id", part_rows: int = PART_ROWS):
        self.spark, self.path, self.key, self.part_rows = spark, path.rstrip("/"), key, part_rows
        self.log = Marks(spark, f"{self.path}/log")

    # ---- the log ----

    def _entries(self) -> list[dict]:
        return sorted((json.loads(text) for text in self.log.read().values()), key=lambda e: (e["order"], e["name"]))

    def parts(self) -> list[Part]:
        """The parts that a reader needs, oldest first."""
        entries = self._entries()
        gone = {run for e in entries for run in e["removes"]}
        return [Part(**{**p, "order": k}) for k, e in enumerate(entries) for p in e["parts"] if p["run"] not in gone]

    def _commit(self, name: str, parts: list[Part], removes: list[str]) -> bool:
        entries = self._entries()
        order = max((e["order"] for e in entries), default=0) + 1
        return self.log.make(name, json.dumps({"name": name, "order": order, "parts": [asdict(p) for p in parts], "removes": removes}))

    # ---- writing ----

    def _write(self, rows: DataFrame, kind: str) -> list[Part]:
        """Writes a run of rows, one a key, in order of key, cut into parts."""
        run = f"{kind}-{uuid.uuid4().hex}"
        n = -(-rows.count() // self.part_rows)
        if not n:
            return []
        cut = rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key)
        cut.withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(f"{self.path}/{run}")
        made = self._run(run).groupBy("__part").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        return [Part(run, r["__part"], kind, r["low"], r["high"], r["rows"], 0) for r in made.orderBy("__part").collect()]

    def _run(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{run}")

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Adds rows, or replaces those with their keys; False, and nothing happens, if a batch of that name is there already.

        Rows without a key are left out. Of rows that repeat a key the greatest one in order of its columns stays.
        """
        if self.log.has(batch):
            return False
        columns = [c for c in rows.columns if c != self.key]
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")) if columns else rows.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        one = one.select(self.key, "__row.*") if columns else one
        return self._commit(batch, self._write(stored(one, "upsert"), UPSERT), [])

    def delete(self, keys: DataFrame, batch: str) -> bool:
        """Takes away the rows of some keys, whether or not they are there; False if a batch of that name is there already."""
        if self.log.has(batch):
            return False
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._commit(batch, self._write(stored(gone, "delete"), DELETE), [])

    def compact(self, batch: str) -> bool:
        """Writes base parts that later parts touch anew, with these, and leaves the others as they are.

        Batches that others commit meanwhile stay behind the new base. Folders of runs that no reader needs any more are left to vacuum().
        """
        parts = self.parts()
        late = [p for p in parts if p.kind != BASE]
        if not late or self.log.has(batch):
            return False
        touched = {p.run for p in parts if p.kind == BASE and any(_meet(p, d) for d in late)}
        if any(d.order < p.order for p in parts if p.kind == BASE for d in late):
            touched = {p.run for p in parts if p.kind == BASE}
        merged = self._merged([p for p in parts if p.run in touched], late, None, None)
        made = self._write(stored(merged, "compacted"), BASE) if merged is not None else []
        return self._commit(batch, made, sorted(touched | {p.run for p in late}))

    def vacuum(self) -> int:
        """Deletes the folders of runs that the log has removed; returns how many. For times when no reader holds an older view."""
        gone = {run for e in self._entries() for run in e["removes"]}
        return sum(self.log.delete(f"{self.path}/{run}") for run in sorted(gone))

    # ---- reading ----

    def read(self, low: object = None, high: object = None) -> DataFrame | None:
        """The rows of all keys, or of those from low to high, both included; None of a collection that has no run to take columns from."""
        parts = [p for p in self.parts() if (low is None or p.high >= low) and (high is None or p.low <= high)]
        base, late = [p for p in parts if p.kind == BASE], [p for p in parts if p.kind != BASE]
        alone = [p for p in base if not any(_meet(p, d) for d in late)]
        out = self._merged([p for p in base if p not in alone], late, low, high)
        for run in sorted({p.run for p in alone}):
            rows = self._within(self._some([p for p in alone if p.run == run]), low, high)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out if out is not None else self._nothing()

    def _nothing(self) -> DataFrame | None:
        kept = [p for p in self.parts() if p.kind != DELETE]
        return self._some(kept[:1]).where(F.lit(False)) if kept else None

    def _some(self, parts: list[Part]) -> DataFrame:
        """Parts of one run; their folders are all that is listed."""
        run = parts[0].run
        return self.spark.read.option("basePath", f"{self.path}/{run}").parquet(*[f"{self.path}/{run}/__part={p.part}" for p in parts]).drop("__part")

    def _within(self, rows: DataFrame, low: object, high: object) -> DataFrame:
        rows = rows if low is None else rows.where(F.col(self.key) >= F.lit(low))
        return rows if high is None else rows.where(F.col(self.key) <= F.lit(high))

    def _merged(self, base: list[Part], late: list[Part], low: object, high: object) -> DataFrame | None:
        """The last row of each key of late parts, and the rows of base parts that no late part has. Only late rows are grouped."""
        runs: dict[str, list[Part]] = {}
        for p in late:
            runs.setdefault(p.run, []).append(p)
        changes = None
        for some in runs.values():
            rows = self._within(self._some(some), low, high).withColumn("__order", F.lit(some[0].order)).withColumn("__kept", F.lit(some[0].kind != DELETE))
            changes = rows if changes is None else changes.unionByName(rows, allowMissingColumns=True)
        old = None
        for run in sorted({p.run for p in base}):
            rows = self._within(self._some([p for p in base if p.run == run]), low, high)
            old = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        if changes is None:
            return old
        columns = [c for c in changes.columns if c not in (self.key, "__order")]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*columns), "__order").alias("__row")).select(self.key, "__row.*")
        fresh = last.where("__kept").drop("__kept")
        if not any(p.kind != DELETE for p in late):
            fresh = None
        if old is None:
            return fresh
        light = F.broadcast if sum(p.rows for p in late) <= 1_000_000 else (lambda df: df)  # keys only
        rest = old.join(light(last.select(self.key)), self.key, "left_anti")
        return rest if fresh is None else rest.unionByName(fresh, allowMissingColumns=True)

    def verify(self, vector: str = "embedding") -> dict[str, int]:
        """Numbers of rows, of rows without a vector, of lengths of vectors, and of parts to merge."""
        rows, parts = self.read(), self.parts()
        if rows is None:
            return {"rows": 0, "without_vector": 0, "lengths": 0, "parts": 0, "late_parts": 0}
        size: Column = F.when(F.col(vector).isNotNull(), F.size(vector))
        n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(vector).isNull()).alias("none"), F.count_distinct(size).alias("lengths")).first()
        return {"rows": n["n"], "without_vector": n["none"], "lengths": n["lengths"], "parts": len(parts), "late_parts": sum(p.kind != BASE for p in parts)}


def _meet(a: Part, b: Part) -> bool:
    return a.low <= b.high and b.low <= a.high
