"""Snapshots of a vault compared and applied: who is new, changed, gone or unchanged, and the tables after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): A, M or D between two listings (path, content_hash); a rename is a D and an A."""
    a = old.select("path", F.col("content_hash").alias("was")).withColumn("in_old", F.lit(True))
    b = new.select("path", F.col("content_hash").alias("now")).withColumn("in_new", F.lit(True))
    op = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(~F.col("was").eqNullSafe(F.col("now")), "M")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).filter("op is not null")


def unchanged(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(path): files whose stored hash is that of the live file; they are not parsed or embedded again."""
    return live.select("path", "content_hash").join(stored.select("path", F.col("content_hash").alias("was")), "path").filter(F.col("content_hash").eqNullSafe(F.col("was"))).select("path")


def removed(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(path): stored files that are no longer there."""
    return stored.select("path").distinct().join(live.select("path"), "path", "left_anti")


def last_modified(changes: DataFrame) -> DataFrame:
    """(path, modified): the time of the newest change of each path; null paths are left out."""
    return changes.filter("path is not null").groupBy("path").agg(F.max("changed_at").alias("modified"))


def latest_state(changes: DataFrame) -> DataFrame:
    """(path, status, changed_at): the last change of each path by changed_at, arrived_at and change_id."""
    last = F.max_by(F.struct("status", "changed_at"), F.struct("changed_at", "arrived_at", "change_id")).alias("c")
    return changes.filter("path is not null").groupBy("path").agg(last).select("path", "c.status", "c.changed_at")


def upsert(stored: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` without the rows of touched paths, and with the fresh rows; a path without fresh rows is deleted."""
    paths = touched.select(F.col("path").alias(key)).distinct()
    return stored.join(paths, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def to_recheck(changes: DataFrame, dirty: DataFrame, dirty_before: DataFrame) -> DataFrame:
    """(path, op): the changes, then dirty paths and those dirty last time as M, each path once, changes first."""
    listed = changes.select("path", "op", F.lit(0).alias("i")).unionByName(dirty.select("path", F.lit("M").alias("op"), F.lit(1).alias("i"))).unionByName(dirty_before.select("path", F.lit("M").alias("op"), F.lit(2).alias("i")))
    return listed.groupBy("path").agg(F.min_by("op", "i").alias("op"))


def run_counts(outcomes: DataFrame) -> DataFrame:
    """(outcome, files) of an index run's (path, outcome)."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("files"))


def decide(forced: bool, model_changed: bool, previous: str | None, known: bool, n_changes: int) -> str:
    """full, incremental or none: how much an index run has to do."""
    if forced or model_changed or previous is None or not known:
        return "full"
    return "incremental" if n_changes else "none"
