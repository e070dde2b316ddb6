"""Change log of a growing collection of text files, taken in as they arrive.

    python -m jobs.changes --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

Each run takes the Parquet files below the input that no run before has taken, in one
micro-batch or in several of `files_per_batch`, and ends. A row is a version of the file
at its path. Below the output there are

- changes/batch=N: what batch N brought: path, status (added or modified), sha256,
  lines, and copy_of, the first path that had the same content already, in the state before
  or in the batch; contents that are as they were give no row, nor are empty ones copies;
- known/batch=N: the paths whose contents batch N set, with their hashes, and in every
  `whole_every`-th batch the whole state, so that a batch reads that and the few since.

A batch that ran halfway runs again under its number: it reads only batches before it
and replaces its own two folders. Checkpoint and output belong together; an output without
its checkpoint is refused, as batches would count from nought again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import as_files, log, main
from tessera.functions import paths
from tessera.operators import snapshots
from tessera.plans.store import exists

KNOWN = "path string, sha256 string, batch long"
CHANGES = "path string, status string, sha256 string, lines int, copy_of string, batch long"


def state(spark: SparkSession, output: str, number: int, whole_every: int) -> DataFrame:
    """path, sha256 as batch `number` finds them: the last whole state before it, and what later batches set."""
    if number == 0:
        return spark.createDataFrame([], "path string, sha256 string")
    whole = (number - 1) // whole_every * whole_every
    rows = spark.read.schema(KNOWN).parquet(f"{output}/known").filter(F.col("batch").between(whole, number - 1))
    return rows.groupBy("path").agg(F.max_by("sha256", "batch").alias("sha256"))


def latest(versions: DataFrame) -> DataFrame:
    """path, text to path, sha256, size, lines: one row for each path; of several versions in one batch that of the greatest hash."""
    narrow = versions.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"), paths.line_count("text").alias("lines"))
    return narrow.groupBy("path").agg(F.max(F.struct("sha256", "size", "lines")).alias("v")).select("path", "v.*")


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """now: as latest gives it. before: path, sha256. What is new or another, and the first path that had its content."""
    changed = snapshots.changed_since(now.select("path", "sha256"), before)
    own = now.join(changed, "path")
    filled = own.filter("size > 0").select("sha256").distinct()
    here = own.filter("size > 0").select("sha256", "path", F.lit(1).alias("turn"))
    there = before.join(filled, "sha256", "left_semi").join(changed.select("path"), "path", "left_anti").select("sha256", "path", F.lit(0).alias("turn"))
    first = here.unionByName(there).groupBy("sha256").agg(F.min_by("path", F.struct("turn", "path")).alias("first"))
    status = F.when(F.col("new"), "added").otherwise("modified")
    copy_of = F.when(F.col("first") != F.col("path"), F.col("first"))
    return own.join(first, "sha256", "left").select("path", status.alias("status"), "sha256", "lines", copy_of.alias("copy_of"))


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """One micro-batch; safe to be run again."""
    spark, every = batch.sparkSession, config["whole_every"]
    log.info("changes: batch %d read %d rows", number, batch.count())
    before = state(spark, output, number, every)
    now = latest(as_files(batch, config)).persist()  # narrow, and read several times; the texts are read once
    compare(now, before).write.mode("overwrite").parquet(f"{output}/changes/batch={number}")
    now.unpersist()
    made = spark.read.schema(CHANGES).parquet(f"{output}/changes/batch={number}")
    known = made.select("path", "sha256")
    if number % every == 0:
        known = known.unionByName(before.join(known, "path", "left_anti"))
    known.write.mode("overwrite").parquet(f"{output}/known/batch={number}")
    n = {r.status: r["n"] for r in made.groupBy("status").agg(F.count("*").alias("n")).collect()}
    log.info("changes: batch %d wrote %d added and %d modified paths below %s", number, n.get("added", 0), n.get("modified", 0), output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> None:
    """The job: takes what is new below source and ends when it is done."""
    if exists(spark, f"{output}/known") and not exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{output} was written with another checkpoint than {checkpoint}")
    stream = spark.readStream.schema(config["schema"])
    if config["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    query = stream.parquet(source).writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("changes: took all that is new below %s", source)


def written(spark: SparkSession, output: str) -> DataFrame:
    """All changes so far; none if no batch has run."""
    place = f"{output}/changes"
    return spark.read.schema(CHANGES).parquet(place) if exists(spark, place) else spark.createDataFrame([], CHANGES)


if __name__ == "__main__":
    main("changes", run, "Change log of a growing collection of text files.", "checkpoint")
