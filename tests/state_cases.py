"""Cases of what runs on the driver or on small trees of their own: stores, states, settings, reports, probes, each with the rows it should give."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import insights
from tessera.plans import reports
from tessera.plans.project import Project
from tessera.plans.queries import table
from tessera.plans.state_queries import _store
from tessera.sources import health, tree
from tessera.sources import project as small

CASES: dict = {}
EXPECTED: dict[str, str] = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__], EXPECTED[f.__name__] = f, sql
        return f

    return add


@query("SELECT * FROM (VALUES ('a/b.py', 'second'), ('c/new.py', 'moved')) t(path, description)")
def stored_descriptions(spark, sf_dir):
    """Set, set again, taken away, moved"""
    store = _store(spark)
    for path, said in (("a/b.py", "first"), ("a/b.py", "second"), ("gone.py", "x"), ("gone.py", None), ("c/old.py", "moved")):
        store.describe(path, said)
    store.move_descriptions(spark.createDataFrame([("c/old.py", "c/new.py")], "old_path string, new_path string"))
    return store.descriptions()


@query("SELECT o_orderkey, '[' || o_custkey || '] ' || o_orderkey AS name, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders QUALIFY place <= 3")
def last_tasks(spark, sf_dir):
    """The tasks closed last, newest first"""
    rows = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(9).collect()
    state = small.load_state("/nowhere")
    for r in reversed(rows):
        state = small.close_task(state, f"[{r.o_custkey}] {r.o_orderkey}", "", str(r.o_orderkey))
    return spark.createDataFrame([(int(t["date"]), t["name"], k + 1) for k, t in enumerate(state["last_tasks"])], "o_orderkey long, name string, place int")


@query("""SELECT * FROM (VALUES ('toml', 'a>=1'), ('toml', 'b[x]'), ('broken', 'c#1'), ('broken', 'd[y]>2'), ('settings', '{"big_file_threshold": 7, "config_version": 1}'), ('damaged', '{"big_file_threshold": 800, "config_version": 1}'),
  ('yaml', '{"system": "s"}'), ('no yaml', '{}'), ('state', '{"active_task": null, "last_tasks": [], "manual_issues": [1]}')) t(what, value)""")
def small_files(spark, sf_dir):
    """Small files read on the driver, damaged and missing ones too"""
    with tempfile.TemporaryDirectory() as folder:
        put = lambda name, text: (Path(folder) / name).write_text(text) and Path(folder) / name
        rows = [("toml", d) for d in small.dependencies('[project]\ndependencies = ["a>=1", "b[x]"]')] + [("broken", d) for d in small.dependencies("x = [\ndependencies = ['c#1', # \"no\"\n\"d[y]>2\"]")]
        said = lambda held, *keys: json.dumps({k: held[k] for k in keys})
        rows += [(n, said(small.load_settings(put("s.json", t)), "big_file_threshold", "config_version")) for n, t in (("settings", '{"big_file_threshold": 7}'), ("damaged", "{"))]
        rows += [("yaml", json.dumps(small.load_yaml(put("m.yaml", '{"system": "s"}')))), ("no yaml", json.dumps(small.load_yaml(Path(folder) / "none.yaml")))]
        rows.append(("state", json.dumps(small.load_state(put("t.json", '{"manual_issues": [1]}')))))
    return spark.createDataFrame(rows, "what string, value string")


@query("""WITH r AS (SELECT n_name, '/w/' || n_regionkey AS root FROM nation WHERE n_nationkey % 5 = n_regionkey % 5 UNION ALL SELECT n_name, '/w/' || n_regionkey || '/' || n_nationkey FROM nation WHERE n_nationkey % 5 <> n_regionkey % 5),
p AS (SELECT r_name, '/w/' || r_regionkey || '/3/deep' AS cwd FROM region UNION ALL SELECT 'out', '/else')
SELECT r_name AS place, coalesce((SELECT max_by(n_name, (length(root), n_name)) FROM r WHERE cwd = root OR starts_with(cwd, root || '/')), 'none') AS project FROM p""")
def resolved_projects(spark, sf_dir):
    """The deepest root around a folder, else the active project"""
    roots = {r.n_name: f"/w/{r.n_regionkey}" + ("" if r.n_nationkey % 5 == r.n_regionkey % 5 else f"/{r.n_nationkey}") for r in table(spark, sf_dir, "nation").collect()}
    registry = {"active_project": "none", "projects": {n: {"root": root} for n, root in roots.items()}}
    places = [(r.r_name, f"/w/{r.r_regionkey}/3/deep") for r in table(spark, sf_dir, "region").collect()] + [("out", "/else")]
    return spark.createDataFrame([(name, small.resolve(registry, None, cwd)) for name, cwd in places], "place string, project string")


@query("SELECT n_name AS name, (SELECT min(b.n_name) FROM nation b WHERE b.n_regionkey = a.n_regionkey) AS held_by FROM nation a WHERE n_name <> (SELECT min(b.n_name) FROM nation b WHERE b.n_regionkey = a.n_regionkey)")
def registered_twice(spark, sf_dir):
    """A root that another name has is refused; each region is a root, and its nations ask for it in order of names"""
    held, refused = {}, []
    for r in table(spark, sf_dir, "nation").orderBy("n_name").collect():
        try:
            held = small.registered(held, r.n_name, f"/w/{r.n_regionkey}")
        except ValueError as e:
            refused.append((r.n_name, str(e).split("'")[1]))
    return spark.createDataFrame(refused, "name string, held_by string")


def _numbered(spark, text: str):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


TREE = {"app/__init__.py": "", "app/a.py": '"""First.\nMore."""\nimport lib.b\n\n\nclass Base:\n    pass\n', "lib/__init__.py": "", "lib/b.py": "import app.a\n\n\nclass One(Base):\n    pass\n\n\nclass Two(Base):\n    pass\n", "main.py": 'import app.a\nif __name__ == "__main__":\n    app.a.Base()\n', "notes.md": "x"}


def literal(spark) -> Project:
    return Project(spark, tree.from_rows(spark, TREE))


def _lines(*lines: str) -> str:
    quoted = ", ".join(f"({n}, '{line.replace(chr(39), chr(39) * 2)}')" for n, line in enumerate([*lines, ""]))
    return f"SELECT n::INTEGER AS n, line FROM (VALUES {quoted}) t(n, line)"


@query(_lines("# QUICKREF", "", "- Project: demo", "- Root: /w", "- Generated: now", "", "## What is this project?", "", "A demo.", "", "## Numbers", "", "- Python files: 5", "- Other files: 1", "- Lines: 24", "- Classes: 3", "- Module functions: 0", "", "## Subsystems", "", "- app (2 files)", "- lib (2 files)", "", "## Entry points", "", "- main.py"))
def report_quickref(spark, sf_dir):
    """K5, F10"""
    return _numbered(spark, reports.quickref(literal(spark), "demo", "/w", "now", "A demo.\n"))


@query(_lines("# Project Map", "", "Every folder and file with a one-line summary.", "", "app/", "  __init__.py  (1 lines)", "  a.py  (8 lines) — First.", "lib/", "  __init__.py  (1 lines)", "  b.py  (10 lines) — all of b", "main.py  (4 lines)", "notes.md"))
def report_map(spark, sf_dir):
    """K6, G8"""
    return _numbered(spark, reports.project_map(literal(spark), spark.createDataFrame([("lib/b.py", "all of b")], "path string, description string")))


@query(_lines("# Dependencies", "", "## Subsystem matrix (rows import columns)", "", "| from \\ to |app|lib|", "|---|---|---|", "| app |-|1|", "| lib |1|-|", "", "## Circular imports (static)", "", "- app/a.py <-> lib/b.py"))
def report_dependencies(spark, sf_dir):
    """K7"""
    return _numbered(spark, reports.dependencies(literal(spark)))


NOTES = {"architecture": {"layers": [{"name": "core", "responsibility": "all"}]}, "design_patterns": [{"name": "p", "note": "n"}], "events": [{"name": "e"}], "capabilities": [{"capability": "c", "component": "x"}], "boot_chain": {"one": [1, {"two": 2}], "three": 3}, "message_flow": ["m"], "shutdown_chain": ["s"]}


@query(_lines("# Architecture", "", "## Subsystems", "", "- app", "- lib", "", "## Layers", "", "### core", "all", "", "## Design patterns", "", "- **p**: n", "", "## Events (1)", "", "- e", "", "## Capabilities", "", "- c: x", ""))
def report_architecture(spark, sf_dir):
    """K10"""
    return _numbered(spark, reports.architecture(literal(spark), NOTES))


@query("SELECT name, n::INTEGER AS n, line FROM (VALUES ('boot', 0, '# Boot'), ('boot', 1, ''), ('boot', 2, '**one**'), ('boot', 3, '  - 1'), ('boot', 4, '  - **two**: 2'), ('boot', 5, '- **three**: 3'), ('boot', 6, ''), ('message', 0, '# Message'), ('message', 1, ''), ('message', 2, '- m'), ('message', 3, '')) t(name, n, line)")
def report_flows(spark, sf_dir):
    """Flows that the notes have; the shutdown chain is in none"""
    return spark.createDataFrame([(name, n, line) for name, text in reports.flows(NOTES).items() for n, line in enumerate(text.split("\n"))], "name string, n int, line string")


@query(_lines("# INSIGHTS", "", "Otomatik kesif sonuclari (LLM gerektirmez).", "", "## Hub moduller (en cok bagimlilik alan)", "", "- `app/a.py`  (2 dosya tarafindan kullaniliyor)", "- `lib/b.py`  (1 dosya tarafindan kullaniliyor)", "", "## Entry-point dosyalar", "", "- `main.py`", "", "## Katman yapisi (subsystem)", "",
  "Seviye 0 = digerleri tarafindan en cok kullanilan (root/kutuphane); buyuk seviye = ust katman (UI/giris).", "- **app**  level 0  (kullanan 2 alt-sistem, bagimli oldugu 1)", "- **lib**  level 1  (kullanan 1 alt-sistem, bagimli oldugu 1)", "", "## Base-class / polymorphic harita", "", "En az 2 alt sinifi olan siniflar.", "- `Base`  tanim: app/a.py:6  alt-siniflar: One (lib/b.py:4), Two (lib/b.py:8)"))
def report_insights(spark, sf_dir):
    """K13, O1, O2, O9"""
    return _numbered(spark, reports.insights(literal(spark)))


@query("""SELECT * FROM (VALUES ('layers', 'app', 'Kutuphane/ortak modul'), ('layers', 'lib', 'UI/giris katmani'), ('entry_points', 'main', 'main.py'), ('design_patterns', 'inheritance_Base', 'Temel sinif Base -> 2 alt sinif (One, Two)'), ('hub_files', 'app/a.py', ''), ('hub_files', 'lib/b.py', '')) t(part, name, said)""")
def report_draft(spark, sf_dir):
    """K13, O12, P15"""
    made = reports.draft_notes(literal(spark))
    rows = [("layers", x["name"], x["responsibility"]) for x in made["architecture"]["layers"]] + [("entry_points", x["name"], x["file"]) for x in made["entry_points"]]
    rows += [("design_patterns", x["name"], x["note"]) for x in made["design_patterns"]] + [("hub_files", x, "") for x in made["dependencies"]["hub_files"]]
    return spark.createDataFrame(rows, "part string, name string, said string")


@query(_lines("# CONTEXT", "", "Last tasks (newest first):", "", "## d2 - two", "", "done", "", "## d1 - one", "", "done", ""))
def report_context(spark, sf_dir):
    """K14, O8"""
    state = small.close_task(small.close_task(small.load_state("/nowhere"), "one", "done", "d1"), "two", "done", "d2")
    return _numbered(spark, reports.context(state))


@query(_lines("# ENVIRONMENT", "", "- Project root: /w", "- Python env: (auto-detect)", "- Ignore dirs: a, b", "- Entry points: main.py", "", "## Health", "", "- Import check: 3 OK / 1 FAIL"))
def report_environment(spark, sf_dir):
    """K14, F10"""
    return _numbered(spark, reports.environment(literal(spark), "/w", {"ignore_dirs": ["b", "a"]}, {"ok": 3, "fail": 1}))


@query(_lines("# ISSUES", "", "## Auto-detected", "", "### Failing imports (runtime health)", "- FAIL x", "", "### Circular imports (static)", "- app/a.py <-> lib/b.py", "", "## Manual", "", "- **t** (high): d"))
def report_issues(spark, sf_dir):
    """K14, F11, O7, O9"""
    return _numbered(spark, reports.issues_report(literal(spark), [{"title": "t", "severity": "high", "detail": "d"}], ["FAIL x"]))


@query("SELECT * FROM (VALUES (['app', 'lib'], 5::BIGINT, 24::BIGINT, 3::BIGINT, 0::BIGINT, 6::BIGINT, 'to show', '', 'none')) t(subsystems, python_files, total_lines, classes, functions, files_analyzed, purpose, errors, dead_code)")
def combined_summary(spark, sf_dir):
    """What the tables say, beside what a client says"""
    answers = spark.createDataFrame([("project_purpose", "to show"), ("dead_code", "none")], "what string, text string")
    row = literal(spark).combined(answers)
    return row.select("architecture.*", F.col("files_analyzed").cast("long").alias("files_analyzed"), "purpose", "errors", "dead_code")


@query("SELECT * FROM (VALUES ('p', 1::BIGINT, 1::BIGINT, 2::BIGINT, 'FAIL', NULL), ('q', 0::BIGINT, 0::BIGINT, 1::BIGINT, 'UNKNOWN', '0/1'), ('top.py', 1::BIGINT, 0::BIGINT, 1::BIGINT, 'OK', NULL)) t(subsystem, ok, failed, expected, state, reported)")
def import_probe(spark, sf_dir):
    """Modules that import, that fail, and that end the interpreter"""
    files = {"p/__init__.py": "", "p/a.py": "raise ValueError('no')\n", "q/c.py": "import os\nos._exit(3)\n", "top.py": "import p\n"}
    p = Project(spark, tree.from_rows(spark, files))
    with tempfile.TemporaryDirectory() as folder:
        for name, source in files.items():
            (Path(folder) / name).parent.mkdir(exist_ok=True)
            (Path(folder) / name).write_text(source)
        lines = health.probe(spark, folder, p.modules())
    return insights.health(lines, p.modules()).select("subsystem", "ok", "failed", "expected", "state", F.nullif(F.regexp_extract("note", r"(\d+/\d+)", 1), F.lit("")).alias("reported"))
