"""Tables that cut a plan: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
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


#: Spark's setting to delete the shuffle files of an execution at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder of the run that is going on, if there is one.
_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All tables that are cut inside lie in one folder, which is deleted at the end; what is to stay is written elsewhere before."""
    folder = f"{shared_folder(spark)}/tables/run-{uuid.uuid4().hex}"
    before = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(before)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession) -> str:
    """A folder of no other table, below that of the run."""
    return f"{_run.get() or shared_folder(spark) + '/tables'}/{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, computed once; the shuffle files that made them are deleted."""
    spark = df.sparkSession
    path = path or new_path(spark)
    schema, before = df.schema, spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(schema).parquet(path)
