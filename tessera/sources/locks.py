"""Locks and whole writes on the driver's own files, and a lock beside a store of any file system."""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

#: Seconds that a writer waits: for a small file, for a project.
SMALL_SECONDS, PROJECT_SECONDS = 10.0, 600.0
#: Tries of a replacement that another process holds up, and seconds between them.
TRIES, PAUSE = 20, 0.05


class Busy(TimeoutError):
    pass


def atomic_write(path: Path, text: str) -> None:
    """Replaces a file in one step; a reader sees the old text or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    other = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    other.write_text(text, encoding="utf-8")
    for k in range(TRIES):
        try:
            return os.replace(other, path)
        except PermissionError:
            if k == TRIES - 1:
                other.unlink()
                raise
            time.sleep(PAUSE)


@contextlib.contextmanager
def locked(path: Path, seconds: float = SMALL_SECONDS) -> Iterator[None]:
    """Holds a lock on a file of the driver; the system lets go of it if the process dies."""
    import fcntl

    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        end = time.monotonic() + seconds
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError as e:
                if time.monotonic() >= end:
                    raise Busy(f"{path} is locked for over {seconds} s") from e
                time.sleep(PAUSE)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


@contextlib.contextmanager
def store_lock(spark: SparkSession, path: str, seconds: float = PROJECT_SECONDS, stale: float = 24 * 3600.0) -> Iterator[None]:
    """Holds a lock file in a store that Spark writes to. It is made only where there is none; one older than `stale` seconds is of a writer that died."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.lock")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = time.monotonic() + seconds
    while True:
        try:
            fs.create(place, False).close()
            break
        except Exception as e:  # the file is there, or the store can't be written
            if not fs.exists(place):
                raise
            if time.time() - fs.getFileStatus(place).getModificationTime() / 1000 > stale:
                fs.delete(place, False)
            elif time.monotonic() >= end:
                raise Busy(f"{path} is locked for over {seconds} s") from e
            else:
                time.sleep(PAUSE)
    try:
        yield
    finally:
        fs.delete(place, False)
