"""A source tree's tables, from one parse of each file."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import extract, findings, graph, insights, joins, quality, snapshots, twins, usage
from ..sources import health, tree
from . import client as clients
from .tables import cut


def wanted(files: DataFrame) -> DataFrame:
    """src, module, kind: what files import at load time, relative imports as modules of the tree."""
    absolute = files.select(F.col("path").alias("src"), F.explode("module_imports").alias("module"), F.lit("abs").alias("kind"))
    rel = files.select(F.col("path").alias("src"), F.explode("relative_imports").alias("r"))
    parts = F.split("src", "/")
    base = F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("r.level"), F.lit(0))))
    relative = rel.select("src", F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.col("r.module"), F.lit(""))).alias("module"), F.lit("rel").alias("kind")).filter("module <> ''")
    return absolute.union(relative)


def targets(known: DataFrame) -> DataFrame:
    """prefix, target, prio: the files that module names stand for. A folder without __init__.py stands for a file of that name in it."""
    known = known.select("path")
    file = known.select(paths.module_path("path").alias("prefix"), F.col("path").alias("target"), F.lit(1).alias("prio"))
    package = known.filter(F.endswith("path", F.lit("/__init__.py"))).select(paths.module_path("path", True).alias("prefix"), F.col("path").alias("target"), F.lit(2).alias("prio"))
    folders = known.select(F.explode(paths.prefixes("path")).alias("dir"), "path").filter("dir <> path").select("dir").distinct()
    space = folders.select(F.replace("dir", F.lit("/"), F.lit(".")).alias("prefix"), F.concat("dir", F.lit("/__init__.py")).alias("target"), F.lit(3).alias("prio"))
    return file.union(package).union(space)


def resolved(imports: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst, kind: wanted() met with targets()."""
    found = joins.longest_prefix(imports, "module", known)
    return joins.exchanged(imports, found, "module").filter("target <> src").select("src", F.col("target").alias("dst"), "kind")


class Project:
    """All tables of a tree. `known` are facts of earlier runs (version, sha256, facts): files that they cover are not parsed again."""

    def __init__(self, spark: SparkSession, raw: DataFrame, known: DataFrame | None = None, rest: DataFrame | None = None):
        """raw: all files, or where `rest` are the others, the Python ones alone."""
        self.spark = spark
        self.sources = cut(tree.split(raw)[0])
        self._rest = raw if rest is None else rest
        self.known = known
        self._found: dict[frozenset, DataFrame] = {}

    @classmethod
    def at(cls, spark: SparkSession, root: str, ignore: list[str] = (), known: DataFrame | None = None) -> Project:
        files = tree.listed(spark, root, ignore)
        return cls(spark, tree.contents(files.filter(tree.is_python()), root), known, tree.contents(files.filter(~tree.is_python()), root))

    @cached_property
    def other_files(self) -> DataFrame:
        return cut(tree.split(self._rest)[1])

    def _contents(self) -> DataFrame:
        """sha256, source_code: the distinct contents. A parse takes long for few bytes, so they are dealt by hash to as many tasks as are set."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.sources.select("sha256", "source_code").repartition(tasks, "sha256").dropDuplicates(["sha256"])

    @cached_property
    def facts(self) -> DataFrame:
        """version, sha256, facts: one row per distinct content."""
        distinct = self._contents()
        if self.known is None:
            return cut(extract.extracted(distinct).select(F.lit(extract.VERSION).alias("version"), "sha256", "facts"))
        missing = snapshots.cache_misses(distinct, self.known, extract.VERSION)
        fresh = extract.extracted(missing).select(F.lit(extract.VERSION).alias("version"), "sha256", "facts")
        old = self.known.filter(F.col("version") == extract.VERSION).join(distinct.select("sha256"), "sha256", "left_semi").select("version", "sha256", "facts")
        return cut(fresh.unionByName(old))

    @cached_property
    def files(self) -> DataFrame:
        """path, size, sha256, lines and all facts of each file."""
        return self.sources.select("path", "size", "sha256", "lines").join(self.facts.select("sha256", "facts"), "sha256").select("path", "size", "sha256", "lines", "facts.*")

    def having(self, *parts: str) -> DataFrame:
        """path, size, sha256, lines and these facts of each file (names of extract.PARTS). Where all facts are at hand they are taken from there; else nothing else is looked for, as most of a parse is not the parser's."""
        if self.known is not None or "facts" in self.__dict__:
            return self.files
        held = next((df for of, df in self._found.items() if of >= {*parts}), None)
        if held is None:
            own = extract.extracted(self._contents(), parts=parts).select("sha256", "facts")
            held = cut(joins.exchanged(self.sources.select("path", "size", "sha256", "lines"), own, "sha256").select("path", "size", "sha256", "lines", "facts.*"))
            self._found[frozenset(parts)] = held
        return held

    @property
    def fingerprint(self) -> DataFrame:
        return self.sources.select("path", "sha256")

    def stats(self) -> DataFrame:
        n = lambda c: F.coalesce(F.sum(c), F.lit(0))
        python = self.having("is_entry", "classes", "functions").agg(
            F.count("*").alias("total_py"), n("lines").alias("total_lines"), n(F.size(F.coalesce("classes", F.array()))).alias("total_classes"), n(F.size(F.coalesce("functions", F.array()))).alias("total_functions"),
            F.array_sort(F.collect_set(paths.subsystem("path", None))).alias("subsystems"), F.array_sort(F.collect_set(F.when(F.col("is_entry"), F.col("path")))).alias("entry_files"),
        )
        rest = self.other_files.agg(F.count("*").alias("total_non_py"))
        one = F.lit(1).alias("one")
        return python.select("*", one).join(rest.select("*", one), "one").drop("one").withColumn("total_files", F.col("total_py") + F.col("total_non_py"))

    def symbols(self) -> DataFrame:
        """path, kind, cls, name, lineno, end_lineno, sig: classes, their methods, and functions."""
        files = self.having("classes", "functions")
        classes = files.select("path", F.explode("classes").alias("c"))
        none = F.lit(None).cast("string")
        a = classes.select("path", F.lit("class").alias("kind"), none.alias("cls"), F.col("c.name").alias("name"), "c.lineno", "c.end_lineno", none.alias("sig"))
        m = classes.select("path", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m"))
        b = m.select("path", F.lit("method").alias("kind"), "cls", F.concat_ws(".", "cls", "m.name").alias("name"), "m.lineno", "m.end_lineno", "m.sig")
        f = files.select("path", F.explode("functions").alias("f"))
        c = f.select("path", F.lit("function").alias("kind"), none.alias("cls"), F.col("f.name").alias("name"), "f.lineno", "f.end_lineno", "f.sig")
        return a.unionByName(b).unionByName(c)

    # ---- imports

    @cached_property
    def import_edges(self) -> DataFrame:
        """src, dst, kind: absolute imports at load time and all relative ones, resolved to files; repeated edges stay, edges to itself don't."""
        return cut(resolved(wanted(self.having("module_imports", "relative_imports")), targets(self.sources)))

    def dependency_matrix(self) -> DataFrame:
        edges = self.import_edges.select(paths.subsystem("src", None).alias("src_area"), paths.subsystem("dst", None).alias("dst_area"))
        return graph.matrix(edges.filter("src_area is not null and dst_area is not null"))

    def import_cycles(self) -> DataFrame:
        plain = lambda c: ~F.endswith(c, F.lit("__init__.py"))
        found = graph.cycles(self.import_edges.filter(plain("src") & plain("dst")))
        return found.orderBy(F.col("members")[0])  # no two have a member in common; the driver sees a sample of what is sorted by

    def adjacency(self) -> DataFrame:
        return graph.adjacency(self.import_edges, self.sources)

    def reverse(self) -> DataFrame:
        return graph.reverse_adjacency(self.import_edges, self.sources)

    def hubs(self) -> DataFrame:
        return graph.hubs(self.import_edges)

    def layers(self) -> DataFrame:
        """Folders of the first level, from the most imported one down, with a label each."""
        edges = self.import_edges.select(paths.first_segment("src").alias("src_area"), paths.first_segment("dst").alias("dst_area"))
        areas = self.sources.select(paths.subsystem("path", None).alias("area")).filter("area is not null").distinct()
        level = cut(graph.levels(areas.join(graph.imports_of_areas(edges), "area", "left").na.fill(0)))
        last = level.agg(F.max("level").alias("last"), F.lit(1).alias("one"))
        both = level.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").drop("one")  # one row
        return both.withColumn("role", insights.role(F.col("level"), F.col("last"), F.col("imported_by"), F.col("imports_others"))).drop("last")

    def classes(self) -> DataFrame:
        return self.having("classes").select("path", F.explode("classes").alias("c")).select("path", "c.name", "c.lineno", "c.bases")

    def base_classes(self) -> DataFrame:
        """The classes with the most subclasses, with their places."""
        return insights.most_extended(self.classes()).orderBy(F.desc("n"), "base", "base_path", "base_line")

    def extensions(self) -> DataFrame:
        """The subclasses of base_classes, with their places."""
        return insights.extensions(self.classes(), self.base_classes())

    def entry_files(self) -> DataFrame:
        """Files with a main guard; where there are none, files in the root with a function named main."""
        main = (F.instr("path", "/") == 0) & F.array_contains(F.transform("functions", lambda f: f["name"]), "main")
        return joins.best_class(self.having("is_entry", "functions"), F.col("is_entry"), main).select("path").orderBy("path")

    def api(self) -> DataFrame:
        """subsystem, files, classes, functions; _root is always there."""
        size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
        made = self.having("classes", "functions").groupBy(paths.subsystem("path").alias("subsystem")).agg(F.count("*").alias("files"), size("classes").alias("classes"), size("functions").alias("functions"))
        root = self.spark.createDataFrame([("_root",)], "subsystem string")
        return made.join(root, "subsystem", "full_outer").na.fill(0)

    def _imports(self) -> DataFrame:
        return self.having("imports").select(F.explode("imports").alias("m")).select(F.split_part("m", F.lit("."), F.lit(1)).alias("imported")).distinct()

    def usage(self, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Declared dependencies that nothing imports, and imports that nothing declares."""
        internal = self.sources.select(F.lower(paths.subsystem("path", None)).alias("name")).filter("name is not null").distinct()
        return usage.unused(declared, self._imports()), usage.undeclared(declared, self._imports(), internal)

    # ---- quality and debt

    def _judged(self) -> DataFrame:
        """What scores and issues are made of, and a report's blocks, from one parse."""
        return self.having("doc", "imports", "classes", "functions", "statements", "names", "branches", "risks", "dynamic")

    def counts(self) -> DataFrame:
        classes = F.coalesce("classes", F.array())
        methods = F.flatten(F.transform(classes, lambda c: c.methods))
        n = lambda c: F.size(F.coalesce(c, F.array()))
        return self._judged().select(
            "path", "lines", n("imports").alias("n_imports"), F.size(classes).alias("n_classes"), F.size(F.filter(classes, lambda c: F.size(c.methods) > 0)).alias("n_classes_with_methods"), F.size(methods).alias("n_methods"),
            F.size(F.filter(methods, lambda m: F.size(m.decorators) > 0)).alias("n_decorated_methods"), F.size(F.flatten(F.transform(methods, lambda m: m.decorators))).alias("n_decorators"), n("functions").alias("n_functions"), "parse_error",
        )

    def scores(self) -> DataFrame:
        return quality.scored(self.counts())

    def issues(self) -> DataFrame:
        return quality.union_rules([quality.count_issues(self.counts()), findings.found(self._judged())])

    def judged(self) -> DataFrame:
        """The scores with the numbers of issues and critical ones of each file."""
        return quality.with_issues(self.scores(), self.issues())

    def hint_coverage(self) -> DataFrame:
        return findings.hint_coverage(self.having("bodies"))

    def functions_ast(self, *parts: str) -> DataFrame:
        """The functions of all files with these facts (names of extract.BODY_PARTS), or with all."""
        return findings.functions(self.having("bodies", *(parts or extract.BODY_PARTS)))

    @cached_property
    def _twins(self) -> DataFrame:
        return cut(twins.twins(self.functions_ast("norm_hash")))

    def twins(self) -> DataFrame:
        """A row for each group of twins."""
        return self._twins

    def twin_members(self) -> DataFrame:
        return twins.members(self.functions_ast("norm_hash"), self._twins)

    def fix_tags(self) -> DataFrame:
        rows = self.sources.select("path", F.posexplode(paths.lines("source_code")).alias("i", "content")).filter(F.contains("content", F.lit("#")) & F.col("content").rlike(f"(?i)({names.TAGS})"))
        return rows.select("path", (F.col("i") + 1).alias("line"), names.tag("content").alias("tag"), names.tag_text("content").alias("text"))

    def callgraph(self) -> DataFrame:
        """name (qualified), path, callees, callers, self_recursive. Methods are known by their class."""
        known, calls = self._calls()
        made = graph.callers(calls, known.select(F.col("qname").alias("name")))
        return made.join(known.groupBy(F.col("qname").alias("name")).agg(F.min("path").alias("path")), "name")

    def _calls(self) -> tuple[DataFrame, DataFrame]:
        """The functions with their qualified names, and caller, callee: the distinct calls between names."""
        known = self.functions_ast("callees").withColumn("qname", paths.qualified(paths.module_path("path"), "cls", "name"))
        order = known.select("qname", F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 9, "0")).alias("ord"))
        calls = known.select(F.col("qname").alias("caller"), F.explode("callees").alias("callee"))
        return known, graph.resolve_calls(calls, order)

    def call_stats(self) -> DataFrame:
        known, calls = self._calls()
        return graph.call_counts(calls, known.select(F.col("qname").alias("name")))

    # ---- lookups

    def find(self, name: str) -> DataFrame:
        """Symbols of that name, a method also by its bare name; else those that contain it. Case does not count."""
        bare = F.lower(F.element_at(F.split("name", r"\."), -1))
        low, wanted = F.lower("name"), name.lower()
        return joins.best_class(self.symbols(), (low == wanted) | (bare == wanted), F.contains(low, F.lit(wanted))).orderBy("path", "lineno", "kind", "name")

    def locate(self, partial: str) -> DataFrame:
        """The path that is meant by a partial one, and how many there are."""
        return joins.suffix_lookup(self.sources.select("path"), "path", self.spark.createDataFrame([(partial,)], "wanted string"), "wanted")

    def outline(self, partial: str) -> DataFrame:
        return self.symbols().join(F.broadcast(self.locate(partial).select("path")), "path").orderBy("lineno")  # one path

    def impact(self, partial: str) -> DataFrame:
        """role (dependent or dependency) and path of the direct neighbours."""
        where = self.locate(partial).first()
        return graph.neighbours(self.import_edges, where.path if where else partial).withColumnRenamed("node", "path")

    def changed_symbols(self, changed_lines: DataFrame) -> DataFrame:
        """changed_lines: path, line. The innermost symbol around each, once, with its first changed line."""
        spans = self.symbols().select("path", F.col("name").alias("symbol"), "lineno", "end_lineno")
        return snapshots.first_changes(joins.innermost(changed_lines, spans, "path", "line", "lineno", "end_lineno", "symbol"), "path", "symbol")

    def new_twins(self, diff: DataFrame) -> DataFrame:
        """Groups that a file added since the last snapshot shares with one that was there before."""
        added = diff.filter("status = 'added'").select("path", F.lit(True).alias("is_new"))
        members = self.twin_members().select("group_id", "path").join(added, "path", "left").na.fill({"is_new": False})
        return twins.gate(members, "group_id", "is_new")

    def modules(self) -> DataFrame:
        return health.modules(self.sources)

    def health(self, lines: DataFrame) -> DataFrame:
        """lines: subsystem, line, as health.probe gives them, or another that tries modules."""
        return insights.health(lines, self.modules())

    def combined(self, said: DataFrame) -> DataFrame:
        """said: what, text: answers of a client to questions on the whole project. One row: what the tables say, beside the answers, empty where there is none."""
        asked = {"purpose": "project_purpose", "tech_infrastructure": "tech_infrastructure", "dev_status": "dev_status", "errors": "errors_missing", "dead_code": "dead_code"}
        answer = lambda kind: F.coalesce(F.max(F.when(F.col("what") == kind, F.col("text"))), F.lit(""))
        texts = said.agg(*[answer(kind).alias(name) for name, kind in asked.items()])
        shape = F.struct("subsystems", F.col("total_py").alias("python_files"), "total_lines", F.col("total_classes").alias("classes"), F.col("total_functions").alias("functions"))
        one = F.lit(1).alias("one")
        own = self.stats().select(shape.alias("architecture"), F.col("total_files").alias("files_analyzed"), one)
        return own.join(texts.select("*", one), "one").drop("one")

    def analyze(self, client, mode: str = "hybrid", types: list[str] | None = None, cancelled=lambda: False, progress=lambda done, of: None, most: int = 40, batch: int = 8, tag: str | None = None) -> DataFrame:
        """The row map of each file, and said and error: what a client of the caller's says of it, and how it failed.

        mode is ast, client (files with an answer only) or hybrid. A client has analyze_files(files, types), where files
        are row maps and types what is asked; its answer has a key for each path, or for each type (see
        asked). It gets at most `most` files, in batches, from tasks. No batch that fails ends the run;
        a run that is cancelled gives no answers.
        """
        if mode not in ("ast", "client", "hybrid"):
            raise ValueError(f"mode {mode!r}")
        progress(1, 4)
        maps = clients.row_maps(self.having("doc", "imports", "classes", "functions"))
        own = maps.withColumnRenamed("rel_path", "path")
        progress(2, 4)
        self.said = self.spark.createDataFrame([], clients.ANSWER)
        if mode != "ast" and client is not None and not cancelled():
            try:
                rows = clients.chosen(maps, most)
                self.said = clients.while_tagged(self.spark.sparkContext, tag, lambda: clients.answers(rows, client, types, batch))
            except Exception:
                if not cancelled():
                    raise
        progress(3, 4)
        rows = self.said.filter("path is not null").select("path", F.col("text").alias("said"), "error")
        progress(4, 4)
        return own.join(rows, "path", "inner" if mode == "client" else "left")

    def asked(self) -> DataFrame:
        """what, text: what the client of the last analyze() said of the project as a whole; for combined()."""
        return clients.of_project(self.said)


class Analyzer:
    """The older form of analyze(): without a client it gives the names alone, with one it asks for most files at once. cancel() ends it from another thread."""

    def __init__(self, client=None, most: int = 4):
        self.client, self.most, self.cancelled = client, most, False
        self.tag = f"tessera-{uuid.uuid4().hex}"
        self.context = None

    def analyze(self, project: Project, progress=lambda done, of: None, types: list[str] | None = None) -> DataFrame:
        self.context = project.spark.sparkContext
        return project.analyze(self.client, "hybrid" if self.client else "ast", types, lambda: self.cancelled, progress, self.most, self.most, self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        if self.context:
            self.context.cancelJobsWithTag(self.tag)
