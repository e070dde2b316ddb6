"""What the corpus operators share: word rule, column picking, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's, Python's and RE2's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOL_CLASS = "[#*$%&|<>]"
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def place(df: DataFrame, name: str) -> int:
    """Where a column stands: that of the exact name, else the first whose name differs in case only."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and not loose:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return (exact or loose)[0]


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ..., which clash with no name, and which of them the named ones are."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{place(df, n)}" for n in names]


def take(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, in that order; extra columns whose names differ in case only do no harm."""
    wide, at = plain(df, *names)
    return wide.select([wide[c].alias(name) for c, name in zip(at, names, strict=True)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text):
    """Words of a text as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none, as in tests, a temporary folder is set; that is refused
    on a cluster, whose executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


#: Spark's setting to delete the shuffle files of an execution at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there; cuts the lineage.

    The shuffle files that made them are deleted, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema, before = df.schema, spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for table in tables:
        fs, place = file_system(table.sparkSession, table._tessera_path)
        fs.delete(place, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch for the session; a larger setting is lowered, a smaller one kept.

    A plan takes the setting when it runs, which for a returned table is later, so it
    is not set back. Very long texts are bounded by Spark itself, which ends a batch at
    64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def sent_if_small(df: DataFrame, label: str, most_rows: int = 1_000_000) -> DataFrame:
    """df of a few narrow columns, written and counted: with at most so many rows it is broadcast, with more it is joined by key."""
    out = written(df, label)
    return F.broadcast(out) if out.count() <= most_rows else out
