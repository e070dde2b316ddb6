"""Source trees with the expected tables worked out by hand, one for each trap."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import extract, findings, graph, joins, quality, snapshots, twins
from tessera.plans import reports
from tessera.plans.project import Project
from tessera.sources import git, tree
from tessera.sources import project as small
from tessera.streaming import incremental

TREE = {
    "p/__init__.py": "",
    "p/a.py": '"""Doc of a.\nMore."""\nimport p.b\n\n\nclass Base:\n    def run(self, x=1, *, y: int = 2) -> int:\n        return self.help(x)\n\n    def help(self, x):\n        return x\n',
    "p/b.py": "import p.a\n\n\nclass One(Base):\n    pass\n\n\nclass Two(a.Base):\n    pass\n",
    "p/q/m.py": "from ..k import z\n",
    "p/k.py": "z = 1  # TODO x\ns = 'TODO'\n# prefix\n# template\n",
    "n/sub/m.py": "def f():\n    import p.a\n    from . import v\n",
    "x/__init__.py": "",
    "x/u.py": "from p import m\nimport n.sub\nimport p.one, p.two\nif TYPE_CHECKING:\n    import p.k\nelse:\n    import p.b\n",
    "main.py": "import json, yaml, numpy\nfrom p.a import Base\n\nif __name__ == '__main__':\n    Base()\n",
    "bad.py": "def f(:\n",
    "bom.py": b"\xef\xbb\xbfx = 1\n",
    "bytes.py": b"s = '\xff'\n",
    "empty.py": "",
    ".hid/a.py": "x = 1",
    "tests/a.py": "x = 1",
    "src/tests/a.py": "x = 1",
    ".x.py": "x = 1",
    "notes.md": "text",
    "Makefile": "all:",
}


@pytest.fixture(scope="module")
def project(spark):
    raw = tree.from_rows(spark, TREE)
    return Project(spark, raw.filter(~paths.ignored("path", [*tree.IGNORE, "tests/*"])))


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan(project):
    files = {r.path: r for r in project.files.collect()}
    assert "p/a.py" in files and ".x.py" in files and not {".hid/a.py", "tests/a.py", "src/tests/a.py"} & set(files)
    assert files["p/a.py"].doc == "Doc of a." and files["p/a.py"].lines == 12
    assert files["bad.py"].parse_error and not files["bom.py"].parse_error and files["empty.py"].lines == 1
    run = files["p/a.py"].classes[0].methods[0]
    assert (run.sig, run.lineno, run.end_lineno) == ("(self, x=1, *, y=2) -> int", 7, 8)
    s = project.stats().first()
    assert s.entry_files == ["main.py"] and s.subsystems == ["n", "p", "x"] and s.total_non_py == 2 and s.total_classes == 3
    assert table(project.other_files, "path", "ext") == [("Makefile", "(none)"), ("notes.md", ".md")]


def test_imports(project):
    edges = table(project.import_edges, "src", "dst", "kind")
    assert ("p/a.py", "p/b.py", "abs") in edges and ("p/q/m.py", "p/k.py", "rel") in edges
    assert [e for e in edges if e[0] == "n/sub/m.py"] == [("n/sub/m.py", "n/sub/__init__.py", "rel")]
    x = [e[1] for e in edges if e[0] == "x/u.py"]
    assert sorted(x) == ["n/sub/__init__.py", "p/__init__.py", "p/__init__.py", "p/__init__.py"]
    assert table(project.dependency_matrix(), "src_area", "dst_area", "n") == [("x", "n", 1), ("x", "p", 3)]
    assert [r.members for r in project.import_cycles().collect()] == [["p/a.py", "p/b.py"]]
    assert dict(table(project.adjacency(), "path", "targets"))["x/u.py"] == ["n/sub/__init__.py", "p/__init__.py"]
    back = dict(table(project.reverse(), "path", "targets"))
    assert back["n/sub/__init__.py"] == ["n/sub/m.py", "x/u.py"] and back["empty.py"] == []
    assert project.hubs().first().dst == "n/sub/__init__.py"
    assert [r.area for r in project.layers().orderBy("level").collect()] == ["p", "n", "x"]


def test_usage(project, spark):
    declared = small.declared(spark, '[project]\ndependencies = ["PyYAML>=6", "requests"]')
    unused, undeclared = project.usage(declared)
    assert table(unused, "declared") == [("requests",)] and table(undeclared, "imported") == [("numpy",)]
    assert small.dependencies('broken = [\ndependencies = ["a", "b"]') == ["a", "b"]
    assert small.dependencies("x = [\ndependencies = [ # the 'list'\n 'a[x]>=1', # 'no'\n \"b\"]\n['c']") == ["a[x]>=1", "b"]
    assert small.dependencies("x = [\noptional = 1") == []


def test_classes_calls_and_tags(project):
    assert [(r.base, [x.sub for x in r.first]) for r in project.base_classes().collect()] == [("Base", ["One", "Two"])]
    calls = {r.name: r for r in project.callgraph().collect()}
    assert calls["p.a.Base.run"].callees == ["self.help"] and calls["p.a.Base.help"].callers == []
    assert table(project.fix_tags(), "path", "line", "tag") == [("p/k.py", 1, "TODO"), ("p/k.py", 3, "FIX"), ("p/k.py", 4, "TEMP")]
    assert project.entry_files().first().path == "main.py"


def test_lookups(project, spark):
    assert [r.name for r in project.find("run").collect()] == ["Base.run"]
    assert [r.name for r in project.find("ase").collect()] == ["Base", "Base.run", "Base.help"]
    assert [r.name for r in project.outline("a.py").collect()] == ["Base", "Base.run", "Base.help"]
    assert table(project.impact("p/k.py"), "role", "path") == [("dependent", "p/q/m.py")]
    lines = spark.createDataFrame([("p/a.py", 8), ("p/a.py", 7), ("p/a.py", 6), ("p/a.py", 1)], "path string, line int")
    assert table(project.changed_symbols(lines), "symbol", "line") == [("Base", 6), ("Base.run", 7)]


def function(name, names=("a", "b", "c")):
    a, b, c = names
    return f"def {name}({a}):\n    {b} = {a} + 1\n    {c} = {b}\n    return {c}\n"


def test_twins(spark):
    p = Project(spark, tree.from_rows(spark, {"a.py": function("f"), "b.py": function("f", "xyz"), "c.py": function("g_v2"), "d.py": "def h():\n    a()\n    b()\n"}))
    got = p.twins().orderBy("group_id").collect()
    assert [(g.group_id, g.method, g.n, [m.path for m in g.first], g.similarity_avg, g.n_bases) for g in got] == [("TG-001", "hash", 2, ["a.py", "b.py"], 100.0, 1), ("TG-002", "kinds", 3, ["a.py", "b.py", "c.py"], 100.0, 2)]
    assert table(p.twin_members(), "group_id", "path", "fuzzy_base") == [("TG-001", "a.py", "f"), ("TG-001", "b.py", "f"), ("TG-002", "a.py", "f"), ("TG-002", "b.py", "f"), ("TG-002", "c.py", "g")]
    assert got[0].remediation.startswith("[2 kopya, benzerlik ~100.0%]")
    diff = snapshots.diff(p.fingerprint.filter("path <> 'b.py'"), p.fingerprint)
    assert table(p.new_twins(diff), "group_id") == [("TG-001",), ("TG-002",)]
    rows = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["b", "c"]), ("k", 3, [])], "bucket string, id int, items array<string>")
    assert table(twins.pair_similarity(rows, "bucket", "id", "items"), "a", "b", "similarity") == [(1, 2, 33.3), (1, 3, 0.0), (2, 3, 0.0)]


def many(n):
    return "def f(x):\n" + "".join(f"    if x == {i}:\n        return {i}\n" for i in range(n - 1))


def test_findings(spark):
    high = "yuksek_ciklik"
    late = "def f():\n    return 1\n    'doc'\n    pass\n    x()\n    y = 1\n"
    risky = "eval(x)\nm.eval()\nyaml.load(f)\nyaml.load(f, Loader=L)\ntoken = 'a'\n"
    stores = "def f(a: int):\n    x = 1\n    def g(b: int):\n        x = 2\n        _y = 3\n        z = b\n    w = z = 4\n    return w\n"
    sources = {f"n{n}.py": many(n) for n in (20, 21, 29, 30, 31)} | {"late.py": late, "risky.py": risky, "stores.py": stores, "h12.py": "".join(f"def f{i}(): pass\n" for i in range(12)), "half.py": "def a(): pass\ndef b(): pass\ndef c() -> int: pass\ndef d(x: int): pass\n", "bad.py": "def (", "none.py": "x = 1"}
    p = Project(spark, tree.from_rows(spark, sources))
    rows = findings.found(p.files).collect()
    kinds = lambda path: sorted((r.type, r.severity, r.kritik) for r in rows if r.path == path and r.type != "missing_type_hint")
    assert kinds("n20.py") == [] and kinds("n21.py") == [(high, "orta", False)] and kinds("n29.py") == [(high, "orta", False)]
    assert kinds("n30.py") == [(high, "yuksek", False)] and kinds("n31.py") == [(high, "yuksek", True)]
    hints = lambda path: [r.detail for r in rows if r.type == "missing_type_hint" and r.path == path]
    assert len(hints("h12.py")) == 11 and any("2 fonksiyon" in h for h in hints("h12.py")) and hints("half.py") == []
    assert [k for k, _, _ in kinds("risky.py")] == ["security_eval_exec", "security_hardcoded_secret", "security_yaml_unsafe_load"]
    assert kinds("late.py") == [("unreachable_code", "orta", False)] * 2 + [("unused_variable", "dusuk", False)]
    assert sorted((r.detail.split("'")[1], r.line) for r in rows if r.path == "stores.py") == [("x", 4), ("x", 4), ("z", 6), ("z", 6)]
    assert kinds("bad.py") == [] and table(p.hint_coverage().filter("path in ('bad.py', 'half.py', 'none.py', 'h12.py')"), "path", "functions", "coverage") == [("bad.py", 0, 100.0), ("h12.py", 12, 0.0), ("half.py", 4, 50.0), ("none.py", 0, 100.0)]
    assert extract.facts("a\x00b")["parse_error"] and extract.facts(None)["imports"] == []


def test_bands_of_scores(spark):
    rows = [(f"f{n}", n, i, 0, 0, 0, 0, 0, f, False) for n, i, f in ((10, 20, 5), (11, 21, 6), (50, 0, 0), (51, 0, 0), (200, 0, 0), (201, 0, 0), (500, 0, 0), (501, 0, 0), (1000, 0, 0), (1001, 0, 0), (1500, 0, 0), (1501, 0, 0))]
    facts = spark.createDataFrame(rows, "path string, lines int, n_imports int, n_classes int, n_classes_with_methods int, n_methods int, n_decorated_methods int, n_decorators int, n_functions int, parse_error boolean")
    assert [r.gereklilik for r in quality.scored(facts).orderBy(F.substring("path", 2, 9).cast("int")).collect()] == [2, 4, 4, 6, 6, 8, 8, 10, 10, 10, 10, 10]
    assert table(quality.count_issues(facts), "path", "type", "severity") == [("f1001", "buyuk_dosya", "orta"), ("f11", "fazla_bagimlilik", "dusuk"), ("f11", "sinif_eksik", "dusuk"), ("f1500", "buyuk_dosya", "orta"), ("f1501", "buyuk_dosya", "kritik")]


def test_moves(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h2"), ("e", "")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "h9"), ("x", "h2"), ("y", "h2"), ("z", "h3"), ("w", "")], "path string, sha256 string")
    got = table(snapshots.diff(old, new), "path", "status", "old_path")
    assert got == [("a", "modified", None), ("e", "deleted", None), ("w", "added", None), ("x", "moved", "b"), ("y", "moved", "c"), ("z", "added", None)]


def test_git(spark, tmp_path):
    diff = '--- a/m.py\n+++ b/m.py\n@@ -1,0 +5,2 @@ def f\n+x\n@@ -9,3 +12,0 @@\n@@ -3 +3 @@\n+++ b/a\\ b.py\n@@ -1 +1 @@\n+++ "b/odd"\n'
    assert table(git.changed_lines(git.text_lines(spark, diff)), "path", "line") == [("a b.py", 1), ("m.py", 3), ("m.py", 5), ("m.py", 6)]
    porcelain = ' M a.py\n?? b.py\nD  c.py\n D d.py\nR  e.py -> f.py\nA  g.pyw\n M h.txt\n?? "i j.py"\n'
    assert dict(table(git.status(git.text_lines(spark, porcelain)), "path", "state")) == {"a.py": "modified", "b.py": "new", "c.py": "deleted", "d.py": "modified", "f.py": "modified", "g.pyw": "new", "i j.py": "new"}
    assert not git.is_repository(str(tmp_path))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert git.is_repository(str(tmp_path))


def test_tree_on_disk_and_facts_kept(spark, tmp_path):
    for name, content in TREE.items():
        place = tmp_path / "r d" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content.encode() if isinstance(content, str) else content)
    p = Project.at(spark, str(tmp_path / "r d"), ["tests/*"])
    assert {r.path for r in p.sources.collect()} == {n for n in TREE if n.endswith(".py") and not n.startswith(".hid") and "tests" not in n}
    (tmp_path / "r d" / "new.py").write_text("import os\n")
    again = Project.at(spark, str(tmp_path / "r d"), ["tests/*"], known=p.facts)
    fresh = Project.at(spark, str(tmp_path / "r d"), ["tests/*"])
    assert snapshots.cache_misses(again.sources, p.facts, extract.VERSION).count() == 1
    assert table(again.files, "path", "imports") == table(fresh.files, "path", "imports")


def test_reports(project, spark):
    about = spark.createDataFrame([("p/k.py", "constants")], "path string, description string")
    made, warnings = reports.knowledge_base(project, about, {"boot_chain": {"one": [1, {"two": 2}]}}, small.DEFAULTS)
    assert "- p (5 files)" in made["QUICKREF.md"] and "  k.py  (5 lines) — constants" in made["PROJECT_MAP.md"]
    assert "| x |1|3|-|" in made["DEPENDENCIES.md"] and "- p/a.py <-> p/b.py" in made["DEPENDENCIES.md"]
    assert f"{'Base.run':<70} method   p/a.py:7" in made["SYMBOL_INDEX.md"]
    assert "- Classes: Base" in made["subsystems/p.md"] and "**one**" in made["flows/boot.md"] and not warnings
    assert "### Unparseable files\n- bad.py" in reports.issues_report(project)
    assert "  python_files: 14" in reports.status(project, "x", "now", small.load_state("/none"))
    assert reports.draft_notes(project)["design_patterns"][0]["note"] == "Temel sinif Base -> 2 alt sinif (One, Two)"
    with pytest.raises(reports.TooLarge):
        reports.guarded("x" * 6_000_000, "big")
    with pytest.raises(reports.BrokenContract):
        reports.require(project.fingerprint, "f", path="string", sha256="binary")
    old = project.fingerprint.filter("path <> 'empty.py'")
    assert "- Added: 1 | Deleted: 0 | Modified: 0 | Moved: 0\n  + empty.py" in reports.change_entry(snapshots.diff(old, project.fingerprint), "sync", "t")


def test_client(project, tmp_path):
    class Client:
        def analyze_files(self, files, types):
            return {f["rel_path"]: len(f) for f in files}

    assert project.analyze(Client(), "ast").filter("said is not null").count() == 0
    assert project.analyze(Client(), "hybrid").count() == 14


def test_client_in_batches(spark, tmp_path):
    """Row maps and types reach the client; it is asked once for a batch, again if it fails, and its faults stay with the batch."""
    p = Project(spark, tree.from_rows(spark, {f"m{k:02d}.py": f"import a{k}\n" + "x = 1\n" * 40 for k in range(20)} | {"test_m.py": "x\n" * 40, "bad.py": "(\n" * 40}))
    log = str(tmp_path)

    class Client:
        def analyze_files(self, files, types):
            import os
            import uuid

            first = files[0]["rel_path"]
            tried = sum(f.startswith(first) for f in os.listdir(log))
            open(os.path.join(log, f"{first}-{uuid.uuid4().hex}"), "w").close()
            if first == "m04.py" or first == "m08.py" and not tried:
                raise OSError("down")
            return {f["rel_path"]: {"imports": f["imports"], "error": f["parse_error"]} for f in files} | {types[0]: f"of {len(files)}"}

    steps = []
    got = p.analyze(Client(), "hybrid", ["purpose"], progress=lambda k, n: steps.append((k, n)), most=14, batch=4)
    said = {r.path: (r.said, r.error) for r in got.collect()}
    assert steps == [(1, 4), (2, 4), (3, 4), (4, 4)] and len(said) == 22
    assert said["m00.py"] == ('{"imports": ["a0"], "error": false}', None) and said["m09.py"][0] and said["m13.py"][0]
    assert [said[f"m{k:02d}.py"] for k in (4, 7)] == [(None, "OSError: down")] * 2
    assert {said[x] for x in ("m14.py", "test_m.py", "bad.py")} == {(None, None)}
    assert {r.what: r.text for r in p.asked().collect()} == {"purpose": "of 4\nof 4\nof 2", "error": "OSError: down"}
    assert {r.path: r.said is None for r in p.analyze(Client(), "client", most=4).collect()} == {f"m{k:02d}.py": False for k in range(4)}
    calls = [f.split("-")[0] for f in __import__("os").listdir(log)]
    assert {x: calls.count(x) for x in ("m00.py", "m04.py", "m08.py", "m12.py")} == {"m00.py": 2, "m04.py": 3, "m08.py": 2, "m12.py": 1}
    assert {r.error for r in p.analyze(object(), "client", most=2).collect()} == {"NotImplementedError: the client has no analyze_files(files, types)"}


def test_a_run_is_cancelled_from_another_thread(spark):
    import threading
    import time

    from tessera.plans.project import Analyzer

    class Slow:
        def analyze_files(self, files, types):
            time.sleep(60)
            return {}

    p = Project(spark, tree.from_rows(spark, {f"m{k}.py": "x = 1\n" * 40 for k in range(4)}))
    p.files.count()
    a = Analyzer(Slow())
    threading.Timer(4, a.cancel).start()
    began = time.time()
    assert a.analyze(p).filter("said is not null").count() == 0 and time.time() - began < 40


def test_settings(tmp_path):
    registry = {"active_project": "z", "projects": {"a": {"root": "/w"}, "b": {"root": "/w/in"}}}
    assert [small.resolve(registry, *x) for x in (("q", "/w"), (None, "/w/in/deep"), (None, "/w/other"), (None, "/"))] == ["q", "b", "a", "z"]
    state = small.load_state(tmp_path / "none")
    for k in range(5):
        state = small.close_task(state, f"t{k}", "done", str(k))
    assert [t["name"] for t in state["last_tasks"]] == ["t4", "t3", "t2"]
    assert small.load_settings(tmp_path / "none")["big_file_threshold"] == 800 and small.load_yaml(tmp_path / "none") == {}


@pytest.mark.parametrize("small", [0, 100])
def test_components_of_random_graphs(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(17)
    for sparse in (34, 45, 70):
        edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(sparse)}
        reach = {n: {n} for e in edges for n in e}
        for _ in range(31):
            for a, b in edges:
                reach[a] |= reach[b]
        want = sorted({tuple(sorted(m for m in reach[n] if n in reach[m])) for n in reach if sum(n in reach[m] for m in reach[n]) > 1})
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        assert sorted(tuple(r.members) for r in graph.cycles(df).collect()) == want
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.path for r in graph.bounded_paths(df, starts, 3).collect()) == [["a", "b"], ["a", "b", "c"]]
    assert table(graph.reachable(df), "src", "dst") == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")]


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    """A ring, a path into it, and a path of cycles: rounds grow with the logarithm of their length."""
    from pyspark.sql import functions as F

    rounds = []
    whole = graph.cut
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or whole(df))
    n = 300_000
    i = F.col("id")
    ring = spark.range(n).select(i.alias("src"), ((i + 1) % n).alias("dst"))
    got = graph.strong_components(ring)
    assert len(rounds) < 40
    assert got.count() == n and [r.component for r in got.select("component").distinct().collect()] == [0]
    rounds.clear()
    m = 3000
    path = spark.range(m).select((n + i).alias("src"), F.when(i == m - 1, 5).otherwise(n + i + 1).alias("dst"))
    handle = spark.range(m).select((2 * n + i).alias("src"), (2 * n + (i + 1) % m).alias("dst")).union(spark.createDataFrame([(2 * n + 7, 2 * n + 1500), (2 * n + 9, n)], "src long, dst long"))
    small_ring = spark.range(m).select(i.alias("src"), ((i + 1) % m).alias("dst"))
    got = graph.strong_components(small_ring.union(path).union(handle))
    assert {(r.component, r["count"]) for r in got.groupBy("component").count().collect()} == {(0, m), (2 * n, m)} and len(rounds) < 120


def test_partial_paths(spark):
    known = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("z/c.py",), ("xc.py",)], "path string")
    wanted = spark.createDataFrame([("c.py",), ("b/c.py",), ("none.py",)], "wanted string")
    assert table(joins.suffix_lookup(known, "path", wanted, "wanted"), "wanted", "path", "candidates") == [("b/c.py", "a/b/c.py", 1), ("c.py", "c.py", 3)]


def test_stream_of_snapshots(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    batches = [[("s0", "a", "1"), ("s0", "b", "2")], [("s1", "a", "1"), ("s1", "c", "2")], [("s2", "a", "9")]]
    for rows in batches:
        spark.createDataFrame(rows, incremental.FINGERPRINT).coalesce(1).write.mode("append").parquet(source)
        incremental.watch(spark, source, store).start().awaitTermination()
    assert table(incremental.changes(spark, store), "batch", "path", "status") == [(0, "a", "added"), (0, "b", "added"), (1, "c", "moved"), (2, "a", "modified"), (2, "c", "deleted")]
