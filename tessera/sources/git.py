"""Git's status and diff output as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECONDS = 30


def run(root: str, *args: str) -> str | None:
    """Git's output on the driver; None if it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return (run(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """n, value: the lines of a text in order."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n long, value string")


def status(lines: DataFrame) -> DataFrame:
    """Porcelain lines: path, state (new, modified or deleted). A rename counts for its new path; only staged deletions are deletions."""
    code, rest = F.substring("value", 1, 2), F.btrim(F.btrim(F.substring("value", 4, 1 << 20)), F.lit('"'))
    path = F.btrim(F.regexp_replace(rest, '^.*? -> "?', ""))
    state = F.when(F.startswith(code, F.lit("??")) | F.startswith(code, F.lit("A")), "new").when(F.startswith(code, F.lit("D")), "deleted").otherwise("modified")
    return lines.filter(F.char_length("value") >= 3).select(path.alias("path"), state.alias("state")).filter(F.col("path").rlike(r"\.pyw?$"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """Lines of a diff without context: path, line (of the new file) for each changed line.

    A diff is one text, so its lines are ordered in one task.
    """
    named = F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1)
    quoted = F.coalesce(F.from_json(F.concat(F.lit("["), F.btrim(named), F.lit("]")), "array<string>")[0], F.btrim(F.btrim(named), F.lit('"')))
    path = F.when(F.startswith("value", F.lit("+++ b/")), F.when(F.startswith(named, F.lit('"')), quoted).otherwise(F.replace(F.btrim(named), F.lit("\\ "), F.lit(" "))))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    filled = lines.withColumn("named", path).withColumn("path", F.last("named", ignorenulls=True).over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    hunks = filled.filter(F.col("value").rlike(hunk) & F.col("path").isNotNull())
    start, count = F.regexp_extract("value", hunk, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("value", hunk, 2), F.lit("")), F.lit("1")).cast("int")
    sized = hunks.select("path", start.alias("start"), count.alias("count")).filter("count > 0")
    return sized.select("path", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line"))
