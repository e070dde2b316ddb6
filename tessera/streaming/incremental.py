"""Snapshots as they arrive: a stream of fingerprint files, each batch compared with what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots

FINGERPRINT = "snapshot_id string, path string, sha256 string"
CHANGE = "batch long, path string, status string, old_path string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(place) else spark.createDataFrame([], schema)


def kept(spark: SparkSession, store: str, before: int) -> DataFrame:
    """The fingerprint that the last batch before this one left."""
    every = _read(spark, f"{store}/kept", f"batch long, {FINGERPRINT}").filter(F.col("batch") < before)
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last) if last is not None else every


def watch(spark: SparkSession, source: str, store: str):
    """A writer that compares each batch of fingerprints below source with the one before, and appends the changes below store.

    A batch that is run again replaces its own folder, so each change is there once.
    Without availableNow the stream goes on; call start() on what is returned.
    """
    stream = spark.readStream.schema(FINGERPRINT).option("maxFilesPerTrigger", 1).parquet(source)

    def compare(batch: DataFrame, number: int) -> None:
        now = batch.select("snapshot_id", "path", "sha256").dropDuplicates(["path"])
        changes = snapshots.diff(kept(batch.sparkSession, store, number), now).filter("status <> 'unchanged'")
        changes.write.mode("overwrite").parquet(f"{store}/changes/batch={number}")
        now.write.mode("overwrite").parquet(f"{store}/kept/batch={number}")

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", f"{store}/offsets").trigger(availableNow=True)


def changes(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/changes", CHANGE)
