"""Where a project's tables, reports and notes are kept, and the job that brings them up to date.

Tables are Parquet below store/tables, snapshots of fingerprints below
store/fingerprint by number, and the log of changes is appended to. Spark's
committer makes each write whole or absent.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..operators import extract, graph, snapshots
from ..sources import project as small
from ..sources import tree
from ..sources.locks import store_lock
from . import lines, reports, upkeep
from .project import Project
from .tables import cut, scratch

DESCRIPTION = "path string, description string"
LOG = "at timestamp, label string, added long, deleted long, modified long, moved long, first array<struct<status:string,old_path:string,path:string>>"
LAYOUT = "version string, buckets int"
#: Partitions of a table of files; a store written with another number is written anew.
BUCKETS = 64
FACT = f"version string, sha256 string, facts {extract.FACTS}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, schema: str) -> DataFrame:
        """A table; an empty one if it was never written."""
        place, none = f"{self.path}/{name}", self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place).select(none.columns) if exists(self.spark, place) else none

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def as_json(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").json(f"{self.path}/json/{name}")

    # ---- tables in buckets by hash of a key

    def bucketed(self, name: str, hit: list[int] | None = None) -> DataFrame:
        """A table that replace() wrote, or some buckets of it."""
        schema = self.spark.read.parquet(f"{self.path}/{name}-schema").schema.add("bucket", T.IntegerType())
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return (rows if hit is None else rows.filter(F.col("bucket").isin(hit))).drop("bucket")

    def table(self, name: str) -> DataFrame:
        return self.bucketed(f"tables/{name}")

    def buckets(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that keys lie in; no more than there are."""
        return sorted(r.bucket for r in keys.select(bucket(key)).distinct().collect())

    def replace(self, name: str, df: DataFrame, key: str, hit: list[int] | None = None) -> None:
        """Writes a table anew, or, with hit, these of its buckets only. Spark splits a bucket that is large, and replaces it as a partition."""
        place = f"{self.path}/{name}"
        rows = df.withColumn("bucket", bucket(key))
        if hit is None:
            self.write(f"{name}-schema", df.limit(0))
        rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static" if hit is None else "dynamic").partitionBy("bucket").parquet(place)
        if hit:
            for b in set(hit) - set(self.buckets(df, key)):
                drop(self.spark, f"{place}/bucket={b}")  # a bucket without rows is no partition to be replaced

    # ---- which tables are whole

    def whole(self) -> bool:
        """Whether the last run came to its end, by these rules."""
        return self.read("layout", LAYOUT).filter((F.col("version") == extract.VERSION) & (F.col("buckets") == BUCKETS)).count() == 1

    def begin(self) -> None:
        drop(self.spark, f"{self.path}/layout")

    def end(self) -> None:
        self.write("layout", self.spark.createDataFrame([(extract.VERSION, BUCKETS)], LAYOUT))

    # ---- fingerprints, by number

    def last(self) -> int:
        known = self.read("fingerprint", "snapshot long, path string, sha256 string").agg(F.max("snapshot")).first()[0]
        return -1 if known is None else known

    def fingerprint(self, number: int) -> DataFrame:
        return self.read("fingerprint", "snapshot long, path string, sha256 string").filter(F.col("snapshot") == number).select("path", "sha256")

    def keep_fingerprint(self, number: int, df: DataFrame) -> None:
        self.write(f"fingerprint/snapshot={number}", df.select("path", "sha256"))

    def changes(self, number: int) -> DataFrame:
        """path, status, old_path: what the snapshot of that number changed."""
        return self.read("changes", "snapshot long, path string, status string, old_path string").filter(F.col("snapshot") == number).select("path", "status", "old_path")

    # ---- descriptions: a small table that is replaced as a whole

    def descriptions(self) -> DataFrame:
        return self.read("descriptions", DESCRIPTION)

    def _replace_descriptions(self, df: DataFrame) -> None:
        self.write("descriptions", cut(df.select("path", "description")))

    def describe(self, path: str, text: str | None) -> None:
        """Sets the description of a path, or takes it away."""
        with store_lock(self.spark, f"{self.path}/locks"):
            others = self.descriptions().filter(F.col("path") != path)
            self._replace_descriptions(others if text is None else others.union(self.spark.createDataFrame([(path, text)], DESCRIPTION)))

    def move_descriptions(self, moved: DataFrame) -> None:
        with store_lock(self.spark, f"{self.path}/locks"):
            self._replace_descriptions(snapshots.rekey(self.descriptions(), moved))

    # ---- the log

    def log(self, diff: DataFrame, label: str) -> None:
        """Appends the counts of a diff, and the first twenty changes of each kind."""
        n = {r.status: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
        first = [(r.status, r.old_path, r.path) for k in ("added", "deleted", "moved") for r in diff.filter(F.col("status") == k).orderBy("path").limit(20).collect()]
        row = self.spark.createDataFrame([(label, *(n.get(k, 0) for k in ("added", "deleted", "modified", "moved")), first)], LOG.replace("at timestamp, ", ""))
        self.write("log", row.select(F.current_timestamp().alias("at"), "*"), "append")

    def history(self, most: int = 3) -> DataFrame:
        return self.read("log", LOG).orderBy(F.desc("at")).limit(most)


def write_reports(folder: str, made: DataFrame, draft: dict | None = None, settings: dict | None = None) -> tuple[list[str], list[str]]:
    """Writes the rows of reports to a folder, and removes reports of an earlier run that are no more; names and warnings. An existing draft stays."""
    settings = small.DEFAULTS | (settings or {})
    if draft is not None:
        made = made.unionByName(lines.text(made.sparkSession, "meta.draft.json", json.dumps(draft, indent=2, ensure_ascii=False) + "\n"))
    return lines.write(made, folder, settings["output_block_mb"], settings["output_warn_mb"], purge=True, keep=("meta.draft.json",))


DEBT = {"twins": lambda p: p.twins(), "twin_members": lambda p: p.twin_members(), "fix_tags": lambda p: p.fix_tags(), "callgraph": lambda p: p.callgraph(), "callgraph_stats": lambda p: p.call_stats()}


def sync(spark: SparkSession, root: str, store: Store, settings: dict | None = None, notes: dict | None = None, folder: str | None = None, label: str = "sync", fresh: bool = False) -> DataFrame:
    """Brings a store up to date with a tree, and returns what changed since the last time.

    Only changed files are parsed, and of those only contents that no earlier run has
    seen; of the tables only the buckets with changed rows are written. Descriptions follow
    moved files; the log and, given a folder, the reports are written; at last the
    fingerprint. A store whose last run broke off, or that other rules wrote, is written
    anew. One run at a time works on a store; with fresh, all contents are parsed again.
    """
    settings = small.DEFAULTS | (settings or {})
    with store_lock(spark, store.path), scratch(spark):
        number = _synced(spark, root, store, settings, notes or {}, folder, label, fresh)
    return store.changes(number)


def _synced(spark: SparkSession, root: str, store: Store, settings: dict, notes: dict, folder: str | None, label: str, fresh: bool) -> int:
    number, whole = store.last(), store.whole() and not fresh
    if whole:
        listing = tree.listed(spark, root, settings["ignore_dirs"])
        python = cut(tree.split(tree.contents(listing.filter(tree.is_python()), root))[0].select("path", "size", "sha256"))
        others = cut(tree.split(tree.contents(listing.filter(~tree.is_python()), root))[1].select("path", "size", "ext", "sha256"))
    else:
        p = Project.at(spark, root, settings["ignore_dirs"], None if fresh else store.read("facts", FACT))
        python = p.sources.select("path", "size", "sha256")
    diff = cut(snapshots.diff(store.fingerprint(number), python).filter("status <> 'unchanged'"))
    store.move_descriptions(diff.filter("status = 'moved'").select("old_path", F.col("path").alias("new_path")))
    store.begin()
    if whole:
        upkeep.update(spark, store, root, python, others, diff, FACT)
    else:
        upkeep.rebuild(store, p)
    if folder:
        p = upkeep.Kept(store)
        write_reports(folder, reports.knowledge_rows(p, store.descriptions(), notes, settings), reports.draft_notes(p), settings)
    store.write(f"changes/snapshot={number + 1}", diff)
    store.log(diff, label)
    store.keep_fingerprint(number + 1, python)
    store.end()
    return number + 1


def new_code(spark: SparkSession, root: str, store: Store, diff: DataFrame, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Checks of a diff: folders that are new, and groups of twins with both a new and an old member."""
    settings = small.DEFAULTS | (settings or {})
    p = Project.at(spark, root, settings["ignore_dirs"], store.read("facts", FACT))
    area = paths.first_segment("path").alias("area")
    before = store.fingerprint(store.last() - 1).select(area)
    return snapshots.new_areas(before, p.fingerprint.select(area), "area"), p.new_twins(diff)


def debt(spark: SparkSession, root: str, store: Store, settings: dict | None = None) -> None:
    """The tables that only their own command writes."""
    settings = small.DEFAULTS | (settings or {})
    with scratch(spark):
        p = Project.at(spark, root, settings["ignore_dirs"], store.read("facts", FACT))
        for name, made in DEBT.items():
            store.write(f"tables/{name}", made(p))


def stored_impact(store: Store, path: str) -> DataFrame:
    """Direct neighbours from the table that is kept, without reading the tree."""
    return graph.neighbours(store.read("tables/import_edges", "src string, dst string, kind string"), path)
