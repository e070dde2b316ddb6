"""Tables of a store brought up to date from what changed.

Tables of files lie in buckets by hash of their key. A run parses changed files only,
and rewrites the buckets that hold a changed row: those of the files themselves, of files
whose imports now lead elsewhere, and of the neighbours of both. Totals, cycles, layers and
hubs are made anew from the kept tables, which have no texts, and only where what they are
made of changed. The tables are those that a run from nothing would write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import graph, quality, snapshots
from ..sources import tree
from .project import Project, resolved, targets, wanted
from .tables import cut

#: Tables in buckets, and the column whose hash says which.
KEYS = {"files": "path", "other_files": "path", "symbols": "path", "scores": "path", "issues": "path", "import_edges": "src", "adjacency": "path", "reverse": "path"}
#: Tables made of the edges and the areas, and of all files.
OF_EDGES = {"matrix": lambda p: p.dependency_matrix(), "cycles": lambda p: p.import_cycles(), "hubs": lambda p: p.hubs(), "layers": lambda p: p.layers()}
OF_FILES = {"api": lambda p: p.api(), "quality_summary": lambda p: quality.summary(p.judged())}
MADE = {
    "files": lambda p: p.files, "other_files": lambda p: p.other_files.select("path", "size", "ext", "sha256"), "symbols": lambda p: p.symbols(), "scores": lambda p: p.scores(), "issues": lambda p: p.issues(),
    "import_edges": lambda p: p.import_edges, "adjacency": lambda p: p.adjacency(), "reverse": lambda p: p.reverse(),
}
#: Of these, those whose rows depend on their own file alone.
OWN = ("files", "symbols", "scores", "issues")


class Kept(Project):
    """A project whose tables are those of a store; it has no texts."""

    def __init__(self, store):
        self.spark, self.store = store.spark, store
        self.files, self.import_edges, self.other_files = store.table("files"), store.table("import_edges"), store.table("other_files")
        self.sources = self.files.select("path", "size", "sha256", "lines")

    def having(self, *parts: str) -> DataFrame:
        return self.files

    def symbols(self) -> DataFrame:
        return self.store.table("symbols")

    def scores(self) -> DataFrame:
        return self.store.table("scores")

    def issues(self) -> DataFrame:
        return self.store.table("issues")


def rebuild(store, p: Project) -> None:
    """All tables of a project, whatever the store holds."""
    store.replace("facts", p.facts, "sha256")  # all facts, which the tables below are made of
    for name, made in MADE.items():
        store.replace(f"tables/{name}", made(p), KEYS[name])
    for name, made in (OF_EDGES | OF_FILES).items():
        store.write(f"tables/{name}", made(p))


def _differ(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one of the two has more often than the other."""
    return old.exceptAll(new).union(new.exceptAll(old))


def update(spark: SparkSession, store, root: str, python: DataFrame, others: DataFrame, diff: DataFrame, facts: str) -> None:
    """python: path, size, sha256 of all Python files now. others: the table other_files now. diff: what changed of python since the tables were written. facts: the schema of the table of facts."""
    other = store.table("other_files")
    names = other.columns
    changed = cut(_differ(other, others.select(names)).select("path").distinct())
    _renew(store, "other_files", changed, others.select(names).join(changed, "path", "left_semi"))
    touched = cut(diff.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct())
    if touched.isEmpty():
        return
    part = Project(spark, tree.contents(python.join(touched, "path", "left_semi").select("path", "size"), root), store.read("facts", facts), spark.createDataFrame([], tree.RAW))
    before = cut(store.table("files").select("path", "sha256").join(touched, "path", "left_semi"))
    _facts(store, part, python, before, facts)
    moved = diff.filter("status <> 'modified'").limit(1).count() > 0
    old_paths = cut(store.table("files").select("path")) if moved else None
    for name in OWN:
        _renew(store, name, touched, MADE[name](part))
    # edges: of changed files, and of those that import what now is another file
    known, imports, sources = targets(python), wanted(part.files), touched.select(F.col("path").alias("src"))
    if moved:
        names_changed = cut(_differ(targets(old_paths), known).select("prefix").distinct())
        others_import = wanted(store.table("files")).join(sources, "src", "left_anti")
        led = others_import.select("src", F.explode(paths.prefixes("module", ".")).alias("prefix")).join(names_changed, "prefix", "left_semi").select("src").distinct()
        led = cut(led)
        imports = imports.union(others_import.join(led, "src", "left_semi"))
        sources = cut(sources.union(led))
    old = cut(store.table("import_edges").join(sources, "src", "left_semi"))
    new = cut(resolved(imports, known).select(old.columns))
    rewired = cut(_differ(old, new))
    if not moved and rewired.isEmpty():
        _of_files(store)
        return
    ends = cut(rewired.select("src").distinct())
    _renew(store, "import_edges", ends, new.join(ends, "src", "left_semi"))
    edges = store.table("import_edges")
    now = python.select("path")
    near = cut(touched.union(ends.select("src")).distinct())
    _renew(store, "adjacency", near, graph.adjacency(edges.join(near.withColumnRenamed("path", "src"), "src", "left_semi"), now.join(near, "path", "left_semi")))
    near = cut(touched.union(rewired.select("dst")).distinct())
    _renew(store, "reverse", near, graph.reverse_adjacency(edges.join(near.withColumnRenamed("path", "dst"), "dst", "left_semi"), now.join(near, "path", "left_semi")))
    p = Kept(store)
    for name, made in OF_EDGES.items():
        store.write(f"tables/{name}", made(p))
    _of_files(store)


def _of_files(store) -> None:
    p = Kept(store)
    for name, made in OF_FILES.items():
        store.write(f"tables/{name}", made(p))


def _renew(store, name: str, keys: DataFrame, rows: DataFrame) -> None:
    """Puts rows in the place of those whose key is one of keys (one column)."""
    key = KEYS[name]
    keys = keys.toDF(key)
    hit = store.buckets(keys, key)
    kept = store.bucketed(f"tables/{name}", hit).join(keys, key, "left_anti")
    store.replace(f"tables/{name}", cut(kept.select(rows.columns).unionByName(rows)), key, hit)


def _facts(store, part: Project, python: DataFrame, before: DataFrame, schema: str) -> None:
    """Facts of new contents come in, those of contents that no file has any more go."""
    shas = cut(part.facts.select("sha256").union(before.select("sha256")).distinct())
    hit = store.buckets(shas, "sha256")
    kept = store.bucketed("facts", hit).join(python.select("sha256"), "sha256", "left_semi").join(part.facts.select("sha256"), "sha256", "left_anti")
    store.replace("facts", cut(kept.select(part.facts.columns).unionByName(part.facts)), "sha256", hit)
