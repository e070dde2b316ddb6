"""Source trees as DataFrames."""

from __future__ import annotations

import fnmatch
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import decoded, extension, line_count
from ..plans.tables import cut, new_path

#: Names and patterns that are left out unless a project says otherwise; fixed values.
IGNORE = [
    ".git", "__pycache__", ".vscode", ".idea", "node_modules", ".venv", "venv", "env", "miniconda*", "anaconda*", ".conda", "java",
    "dist", "build", "site-packages", "Lib", "Scripts", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pypackages__",
]
RAW = "path string, size long, content binary"
LISTED = "path string, size long, is_folder boolean"
#: What one task reads at most, unless a single file is larger, and how many folders it lists.
TASK_BYTES, TASK_FILES, TASK_FOLDERS = 64 << 20, 2000, 256
#: Folders that a task lists at once, and the bytes of files that it hands on together.
LISTERS, BATCH_BYTES = 16, 8 << 20


def _opened(root: str):
    """The file system of a root, and the root's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/"))


def _matches(name: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(name, p) for p in patterns)


def _lister(root: str, ignore: list[str]):
    """A task that lists folders: batches of their paths become batches of what lies in them."""

    def listed(batches):
        from pyarrow import fs

        store, base = _opened(root)
        inside = lambda folder: store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=bool(folder)))
        with ThreadPoolExecutor(LISTERS) as pool:
            for batch in batches:
                for at in range(0, len(batch), LISTERS):
                    for infos in pool.map(inside, batch.path[at : at + LISTERS]):
                        folders = [x for x in infos if x.type == fs.FileType.Directory and not x.base_name.startswith(".") and not _matches(x.base_name, ignore) and not _matches(x.base_name + "/", ignore)]
                        files = [x for x in infos if x.type == fs.FileType.File and not _matches(x.base_name, ignore)]
                        rows = [(x.path[len(base) :].lstrip("/"), x.size or 0, x.type == fs.FileType.Directory) for x in folders + files]
                        yield pd.DataFrame(rows, columns=["path", "size", "is_folder"])

    return listed


def listed(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """path (relative) and size of all files below root that are not ignored.

    Level by level: the folders of a level are dealt to tasks, and what they find is
    written, so that nothing below an ignored folder is ever listed, and the driver
    holds no path. One folder is listed by one task. Spark's own file sources leave out
    names that begin with _ or a dot, and files without bytes; here those are files like any other.
    """
    base, level, n = new_path(spark), 0, 1
    folders = spark.createDataFrame([("",)], "path string")
    visit = _lister(root, [*IGNORE, *ignore])
    while n:
        found = cut(folders.repartition(-(-n // TASK_FOLDERS), "path").mapInPandas(visit, LISTED), f"{base}/level={level}")
        folders = found.filter("is_folder").select("path")
        n, level = folders.count(), level + 1
    return spark.read.schema(f"{LISTED}, level int").parquet(base).filter("not is_folder").select("path", "size")


def contents(listing: DataFrame, root: str) -> DataFrame:
    """listing: path, size. path, size, content of the files, read in tasks of some TASK_BYTES; unreadable ones are skipped."""
    n = listing.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, -(-n.bytes // TASK_BYTES), -(-n.files // TASK_FILES))

    def read(batches):
        store, base = _opened(root)
        rows, held = [], 0
        for batch in batches:
            for path in batch.path:
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                except OSError:
                    continue
                rows.append((path, len(data), data))
                held += len(data)
                if held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "size", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "size", "content"])

    return listing.select("path").repartition(tasks, "path").mapInPandas(read, RAW)


def is_python(path: str = "path"):
    return F.endswith(path, F.lit(".py"))


def raw_files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """All files below root that are not ignored: path (relative), size, content. Unreadable ones are skipped."""
    return contents(listed(spark, root, ignore), root)


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Python files with hash, source and line count, and the other files with their extension."""
    python = raw.filter(is_python()).select("path", "size", F.sha2("content", 256).alias("sha256"), decoded("content").alias("source_code"))
    other = raw.filter(~is_python()).select("path", "size", extension("path").alias("ext"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))
    return python.withColumn("lines", line_count("source_code")), other


def from_rows(spark: SparkSession, files: dict[str, bytes | str]) -> DataFrame:
    """A tree from memory, in the shape of raw_files."""
    data = [(p, c.encode() if isinstance(c, str) else c) for p, c in files.items()]
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in data], "path string, size long, content binary")
