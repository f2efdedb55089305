"""Batches, checkpoints and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.sources.store import stored

STATES = ["PENDING", "IN_PROGRESS", "SUCCESS", "FAILED"]


#: Keys of a range in which places are counted apart.
RANGE_KEYS = 1_000_000


def places(docs: DataFrame, order: str, within: tuple[str, ...] = (), range_keys: int = RANGE_KEYS) -> DataFrame:
    """docs with __at: each row's place from 0 in order of a key, among rows equal in the columns within; rows that repeat a key follow each other in any order.

    Places come from the keys alone, counted in as many ranges as their number needs and added up over ranges; only then rows are joined with them,
    by their whole key. So neither a sort nor a task grows with what other columns hold, or with a group of very many rows.
    """
    by = [*within, order]
    names = [f"__k{i}" for i in range(len(by))]
    keys = docs.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.count("*").alias("__n"))
    n = max(1, -(-docs.count() // range_keys))
    ranged = stored(keys.repartitionByRange(n, names[-1]).withColumn("__part", F.spark_partition_id()), "keys")
    group = names[:-1]
    inside = Window.partitionBy(*group, "__part").orderBy(names[-1])
    upto = Window.partitionBy(*group).orderBy("__part")
    before = ranged.groupBy(*group, "__part").agg(F.sum("__n").alias("__rows")).withColumn("__before", F.sum("__rows").over(upto) - F.col("__rows")).drop("__rows")
    same = F.col("a.__part") == F.col("b.__part")
    for c in group:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = ranged.withColumn("__inside", F.sum("__n").over(inside) - F.col("__n")).alias("a").join(before.alias("b"), same).select(*(F.col(f"a.{c}") for c in names), "a.__n", (F.col("__before") + F.col("__inside")).alias("__first"))
    match = F.lit(True)
    for c, name in zip(by, names, strict=True):
        match &= docs[c].eqNullSafe(F.col(name))
    found = docs.join(placed, match)
    if ranged.where("__n > 1").isEmpty():
        return found.withColumn("__at", F.col("__first")).drop(*names, "__n", "__first")
    twin = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))) - 1
    return found.withColumn("__at", F.col("__first") + twin).drop(*names, "__n", "__first")


def batches(docs: DataFrame, sizes: list[int], order: str = "doc_id") -> DataFrame:
    """docs with batch_no: runs of the given sizes in order of a numeric key, the last size again and again."""
    placed = places(docs, order)
    upto = 0
    number = None
    for i, size in enumerate(sizes):
        upto += size
        test = F.col("__at") < upto
        number = F.when(test, i + 1) if number is None else number.when(test, i + 1)
    number = number.otherwise(len(sizes) + 1 + F.floor((F.col("__at") - upto) / sizes[-1]))
    return placed.withColumn("batch_no", number.cast("long")).drop("__at")


def latest(events: DataFrame, key: str, status: Column, at: Column) -> DataFrame:
    """key, status, n_events: the status of each key's last event; ties go to the greater status."""
    return events.groupBy(key).agg(F.max(F.struct(at.alias("at"), status.alias("status")))["status"].alias("status"), F.count("*").alias("n_events"))


def rollup(statuses: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """status, n over all known keys; keys without an event are pending, those in progress are pending again after a crash."""
    merged = known.select(key).distinct().join(statuses, key, "full_outer")
    state = F.when(F.col("status").isNull() | (F.col("status") == "IN_PROGRESS"), "PENDING").otherwise(F.col("status"))
    return merged.groupBy(state.alias("status")).agg(F.count("*").alias("n"))


def pending(known: DataFrame, statuses: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Known keys that must run: not successful, or successful without a valid result."""
    done = statuses.where("status = 'SUCCESS'").join(valid.select(key).distinct(), key, "left_semi")
    return known.select(key).distinct().join(done, key, "left_anti")
