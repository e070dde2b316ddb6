"""Queries on what is kept, reported and asked: stores, logs, reports, clients, paths and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import graph
from . import queries, reports
from .queries import FILES, SNAPSHOTS, query, table
from .source_queries import EDGES, P, project
from .store import LOG, Store
from .tables import shared_folder


def _store(spark) -> Store:
    import uuid

    return Store(spark, f"{shared_folder(spark)}/tables/store-{uuid.uuid4().hex}")


# ---- sinks


@query(f"WITH {SNAPSHOTS} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'moved') AS moved, list_sort(list(status || ' ' || coalesce(old_path, '') || ' ' || path) FILTER (rn <= 20 AND status IN ('added', 'deleted', 'moved'))) AS first FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS rn FROM d WHERE status <> 'unchanged')")
def stored_log(spark, sf_dir):
    """K3: an entry of the log, as it is read back"""
    from ..operators import snapshots

    store = _store(spark)
    store.log(snapshots.diff(*queries._snapshots(spark, sf_dir)).filter("status <> 'unchanged'"), "sync")
    said = F.transform("first", lambda x: F.concat(x["status"], F.lit(" "), F.coalesce(x["old_path"], F.lit("")), F.lit(" "), x["path"]))
    return store.read("log", LOG).select("added", "deleted", "modified", "moved", F.array_sort(said).alias("first"))


@query(f"WITH {FILES} SELECT path, sha256(text) AS sha256, 1::BIGINT AS last FROM f")
def stored_fingerprint(spark, sf_dir):
    """The later of two snapshots"""
    store = _store(spark)
    now = queries.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("sha256"))
    store.keep_fingerprint(0, now.limit(3))
    store.keep_fingerprint(1, now)
    return store.fingerprint(store.last()).withColumn("last", F.lit(store.last()).cast("long"))


@query("SELECT p_partkey, p_name, p_size, [p_brand, p_type] AS tags FROM part")
def stored_json(spark, sf_dir):
    """A table as JSON, read back"""
    store = _store(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.array("p_brand", "p_type").alias("tags"))
    store.as_json("part", rows)
    return spark.read.schema(rows.schema).json(f"{store.path}/json/part")


# ---- reports


@query(f"""WITH {P}, s AS (SELECT path, cls, s, unnest([0, 1, 2, 3, 4, 5]) AS i FROM p WHERE NOT bad),
t AS (SELECT path, [cls, cls || '.size', cls || '.wait', 'make', 'branchy', 'pick_v2'][i + 1] AS name, ['class', 'method', 'method', 'function', 'function', 'function'][i + 1] AS kind, [20, 23, 27, 30, 40, 44 + s][i + 1] AS lineno FROM s)
SELECT name, printf('%-70s %-8s %s:%s', name, kind, path, lineno::VARCHAR) AS line FROM t""")
def symbol_lines(spark, sf_dir):
    """The lines of the symbol index"""
    return reports.symbol_lines(project(spark, sf_dir).symbols()).select("name", "line")


@query(f"""WITH {P} SELECT split_part(path, '/', 1) AS area, path, CASE WHEN bad THEN '- Classes: -' ELSE '- Classes: ' || cls END AS classes, CASE WHEN bad THEN '- Functions: -' ELSE '- Functions: make, branchy, pick_v2' END AS functions FROM p WHERE k % 50 <> 0""")
def subsystem_blocks(spark, sf_dir):
    """What a folder's report says of each file"""
    about = spark.createDataFrame([], "path string, description string")
    line = F.split("line", "\n")
    found = lambda head: F.element_at(F.filter(line, lambda x: F.startswith(x, F.lit(head))), 1)
    return reports.file_blocks(project(spark, sf_dir), about).select("area", "path", found("- Classes: ").alias("classes"), found("- Functions: ").alias("functions"))


@query(f"""WITH {P} SELECT path, coalesce(nullif(CASE WHEN k % 3 = 0 THEN 'said of ' || k WHEN k % 3 = 1 THEN '' END, ''), CASE WHEN NOT bad THEN 'Part ' || k || ': ' || p_name || '.' END, '') AS about FROM p""")
def described_files(spark, sf_dir):
    """What is said of a file, else its own first line, else nothing"""
    p = project(spark, sf_dir)
    number = F.regexp_extract("path", r"p(\d+)\.py$", 1).cast("int")
    given = p.sources.filter(number % 3 < 2).select("path", F.when(number % 3 == 0, F.concat(F.lit("said of "), number)).otherwise("").alias("description"))
    return reports.described(p.having("doc"), given).select("path", "about")


@query(f"WITH {FILES} SELECT path AS name, strlen(text) / 1048576.0::DOUBLE AS megabytes, CASE WHEN strlen(text) / 1048576.0::DOUBLE > 0.004 THEN 'block' WHEN strlen(text) / 1048576.0::DOUBLE > 0.001 THEN 'warn' ELSE 'ok' END AS state FROM f")
def report_sizes(spark, sf_dir):
    """Sizes before anything is written"""
    return reports.sizes(queries.files(spark, sf_dir).select(F.col("path").alias("name"), "text"), 0.001, 0.004)


@query(f"""WITH {P}, n AS (SELECT *, CASE WHEN NOT bad THEN row_number() OVER (PARTITION BY bad ORDER BY path) END AS place FROM p), b AS (SELECT *, CASE WHEN place <= 40 THEN (place - 1) // 8 END AS batch FROM n),
f AS (SELECT *, batch IS NOT NULL AND bool_or(k % 13 = 0) OVER (PARTITION BY batch) AS fails FROM b)
SELECT path, CASE WHEN batch IS NOT NULL AND NOT fails THEN 'has ' || cls END AS said, CASE WHEN fails THEN 'ValueError: no' END AS error, bad AS parse_error, CASE WHEN bad THEN [] ELSE [cls] END AS classes,
  CASE WHEN bad THEN [] ELSE ['make', 'branchy', 'pick_v2'] END AS functions FROM f""")
def client_analysis(spark, sf_dir):
    """The row map of each file, and a client's word on the first forty that parse; where it fails, its fault in the rows of the batch"""

    class Client:
        def analyze_files(self, files, types):
            if any(int(f["rel_path"].rsplit("p", 2)[-2].strip(".")) % 13 == 0 for f in files):
                raise ValueError("no")
            return {f["rel_path"]: "has " + f["classes"][0] for f in files}

    return project(spark, sf_dir).analyze(Client()).select("path", "said", "error", "parse_error", "classes", "functions")


# ---- paths


@query(f"""WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
w AS (SELECT ['b1/p190.py'] AS path UNION ALL SELECT list_append(path, dst) FROM w JOIN d ON path[-1] = src WHERE len(path) < 10 AND path[-1] <> 'b1/p1.py' AND NOT list_contains(path, dst)),
f AS (SELECT path[-1] AS node, min((len(path), path)) AS best FROM w WHERE path[-1] <> 'b1/p1.py' GROUP BY 1),
t AS (SELECT list_append(best[2], 'b1/p1.py') AS path FROM f JOIN d ON node = src WHERE dst = 'b1/p1.py' AND len(best[2]) < 10)
SELECT path FROM t ORDER BY len(path), path LIMIT 20""")
def source_paths(spark, sf_dir):
    """Paths of imports from one file to another, by a search in breadth that goes on from each file once"""
    return graph.call_paths(project(spark, sf_dir).import_edges, "b1/p190.py", "b1/p1.py")


@query("SELECT p_partkey, 'b' || p_partkey % 7 || '.p' || p_partkey || '.' || p_brand || CASE WHEN p_size % 2 = 0 THEN '.' || split_part(p_name, ' ', 2) ELSE '' END AS qualified FROM part")
def qualified_names(spark, sf_dir):
    """A part that is null is left out"""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", paths.qualified(paths.module_path(F.format_string("b%d/p%d.py", k % 7, k)), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("qualified"))


@query("SELECT p_partkey, round(p_retailprice / 7, 1) AS one, round(p_retailprice / 7, 2) AS two, least(greatest(p_size - 10, 0), 30)::INTEGER AS clamped FROM part")
def rounded_numbers(spark, sf_dir):
    """Rounded as SQL does, T9"""
    price = F.col("p_retailprice") / 7
    return table(spark, sf_dir, "part").select("p_partkey", F.round(price, 1).alias("one"), F.round(price, 2).alias("two"), F.least(F.greatest(F.col("p_size") - 10, F.lit(0)), F.lit(30)).alias("clamped"))


@query("SELECT p_brand, list_sort(list(DISTINCT lower(regexp_replace(replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_v' || p_size ELSE '' END, '(?i)(_v\\d+|_new|_old|_fix|_copy|_dup|V2|New)$', '')))) AS bases FROM part GROUP BY p_brand")
def fuzzy_bases(spark, sf_dir):
    """X5, A21"""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_v"), "p_size")).otherwise(""))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(names.fuzzy_base(name))).alias("bases"))
