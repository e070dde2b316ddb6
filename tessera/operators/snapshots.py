"""Snapshot comparison: what was added, deleted, modified, and moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .joins import rank_pairs


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: path, sha256. One row per path: status (added, deleted, modified or unchanged), and both hashes.

    A narrow table, written once: what follows reads it several times, and the texts that the hashes are of only here.
    """
    o, n = old.select("path", F.col("sha256").alias("old_sha")), new.select("path", F.col("sha256").alias("new_sha"))
    both = o.join(n, "path", "full_outer")
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified").otherwise("unchanged")
    return cut(both.select("path", status.alias("status"), "old_sha", "new_sha"))


def moves(classified: DataFrame) -> DataFrame:
    """Deleted paths paired with added ones of equal hash, in order of path: old_path, new_path, sha256."""
    gone = classified.filter("status = 'deleted'").select(F.col("path").alias("old_path"), F.col("old_sha").alias("sha256"))
    come = classified.filter("status = 'added'").select(F.col("path").alias("new_path"), F.col("new_sha").alias("sha256"))
    return rank_pairs(gone, come, "sha256", "old_path", "new_path").select("old_path", "new_path", "sha256")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, old_path; a move is one row at its new path, and its ends are neither added nor deleted."""
    classified = classify(old, new)
    moved = cut(moves(classified))
    ends = moved.select(F.explode(F.array("old_path", "new_path")).alias("path"))
    rest = classified.filter("status in ('added', 'deleted')").join(ends, "path", "left_anti")
    same = classified.filter("status not in ('added', 'deleted')")
    none = F.lit(None).cast("string").alias("old_path")
    return rest.unionByName(same).select("path", "status", none).unionByName(moved.select(F.col("new_path").alias("path"), F.lit("moved").alias("status"), "old_path"))


def rekey(kv: DataFrame, moved: DataFrame, key: str = "path") -> DataFrame:
    """kv with the keys of moved paths replaced, where the new key is not there yet."""
    taken = kv.select(F.col(key).alias("new_path"))
    valid = moved.join(taken, "new_path", "left_anti").select(F.col("old_path").alias(key), "new_path")
    return kv.join(valid, key, "left").withColumn(key, F.coalesce("new_path", key)).drop("new_path")


def changed_since(scan: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Paths whose hash is not the one kept, or that have none: path, new."""
    kept = fingerprint.select("path", F.col("sha256").alias("kept"))
    return scan.join(kept, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("kept"))).select("path", F.col("kept").isNull().alias("new"))


def cache_misses(now: DataFrame, facts: DataFrame, version: str) -> DataFrame:
    """Rows of now whose content was not yet extracted by this version: only these need work."""
    known = facts.filter(F.col("version") == version).select("sha256").distinct()
    return now.join(known, "sha256", "left_anti")


def new_areas(old: DataFrame, new: DataFrame, area: str) -> DataFrame:
    """Areas of new that old has nothing in."""
    return new.select(area).distinct().join(old.select(area).distinct(), area, "left_anti")


def first_changes(changes: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    return changes.groupBy(*keys).agg(F.min(line).alias(line))
