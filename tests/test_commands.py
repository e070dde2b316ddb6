import json
import subprocess
import sys
import threading
import time

import pytest

from tessera.operators import graph, insights
from tessera.plans import commands
from tessera.plans.project import Analyzer, Project
from tessera.sources import health, locks, tree
from tessera.sources import project as small

FILES = {
    "p/__init__.py": "", "p/a.py": "import p.b\n\n\ndef run(x):\n    y = x\n    return y\n", "p/b.py": "raise ValueError('no')\n", "q/c.py": "import sys\nprint('[\"q\", \"q.c\", \"FAIL\"]')\nsys.exit(3)\n", "q/d.py": "x = 1  # TODO\n", "main.py": "import p\n",
}


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "tree"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def said(spark, capsys, registry, *argv):
    capsys.readouterr()
    assert commands.main([*argv, "--json"] if argv[0] not in commands.QUIET else list(argv), spark, str(registry)) == 0
    out = capsys.readouterr().out
    return json.loads(out) if argv[0] not in commands.QUIET else out


def test_commands(spark, capsys, tmp_path, place):
    registry = tmp_path / "registry.json"
    run = lambda *argv: said(spark, capsys, registry, *argv)
    made = run("init", "--project-root", str(place), "--project-name", "My Tree")
    assert made["project"] == "my-tree" and made["made"] == [".gitignore", "pyproject.toml"]
    assert commands.main(["init", "--project-root", str(place), "--project-name", "other"], spark, str(registry)) == 1
    assert "already registered" in capsys.readouterr().err
    assert [p["name"] for p in run("list")] == ["my-tree"] and run("select", "my-tree")["root"] == str(place) and run("current")["name"] == "my-tree"
    assert commands.main(["current", "--project", "none"], spark, str(registry)) == 1
    stats = run("scan")
    assert stats["total_py"] == 6 and stats["quality"]["total_files"] == 6
    assert "- **added**: 6" in run("sync")
    assert [r["name"] for r in run("find", "run")] == ["run"] and [r["name"] for r in run("outline", "a.py")] == ["run"]
    assert [(r["role"], r["path"]) for r in run("impact", "p/b.py")] == [("dependent", "p/a.py")]
    assert run("desc", "p/a.py", "the", "first") == [{"path": "p/a.py", "description": "the first"}] and run("desc", "list")[0]["path"] == "p/a.py"
    assert run("desc", "none")["error"] == "not_found"
    assert run("techdebt")["fix_tags"] == 1
    for k in range(4):
        state = run("close-task", "--name", f"t{k}", "--summary", "done")
    assert [t["name"] for t in state["last_tasks"]] == ["t3", "t2", "t1"]
    (place / "q/d.py").write_text("x = 2\n")
    assert run("changed") == {"source": "fingerprint", "files": [{"path": "q/d.py", "new": False}], "symbols": []}
    subprocess.run(["git", "init", "-q", str(place)], check=True)
    subprocess.run(["git", "-C", str(place), "add", "-A"], check=True)
    subprocess.run(["git", "-C", str(place), "-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "x"], check=True)
    (place / "p/a.py").write_text(FILES["p/a.py"].replace("y = x", "y = x + 1"))
    assert run("changed") == {"source": "git", "files": [{"path": "p/a.py", "state": "modified"}], "symbols": [{"path": "p/a.py", "symbol": "run", "line": 5}]}
    found = run("check")
    assert found["summary"] == {"ok": 2, "fail": 2, "expected": 6} and found["by_subsystem"]["q"]["state"] == "UNKNOWN" and found["by_subsystem"]["p"]["state"] == "FAIL"
    assert "FAIL p.b ValueError no" in (place / ".tessera/state/ISSUES.md").read_text()
    assert "SYMBOL_INDEX.md" in run("report") and (place / ".tessera/KB/SYMBOL_INDEX.md").exists()
    assert run("scaffold") == {"made": []}


def test_probe(spark, place):
    p = Project.at(spark, str(place))
    lines = health.probe(spark, str(place), p.modules())
    got = {(r.subsystem, r.module): r.line for r in lines.collect()}
    assert got == {("main.py", "main"): "OK main", ("p", "p"): "OK p", ("p", "p.a"): "FAIL p.a ValueError no", ("p", "p.b"): "FAIL p.b ValueError no"}
    state = {r.subsystem: (r.ok, r.failed, r.expected, r.state) for r in p.health(lines).collect()}
    assert state == {"main.py": (1, 0, 1, "OK"), "p": (1, 2, 3, "FAIL"), "q": (0, 0, 2, "UNKNOWN")}
    (place / "q/c.py").write_text("import time\ntime.sleep(60)\n")
    slow = health.probe(spark, str(place), p.modules().filter("subsystem <> 'p'"), all_seconds=3, area_seconds=3)
    assert {r.module for r in slow.collect()} == {"main"}
    none = health.probe(spark, str(place), p.modules(), python="/none/python")
    assert all(r.line.startswith("ERROR") for r in none.collect()) and none.count() >= 3
    assert insights.failing(lines).count() == 2


def test_locks(tmp_path, spark):
    order = []

    def held(name, seconds):
        with locks.locked(tmp_path / "x.lock"):
            order.append(name)
            time.sleep(seconds)
            order.append(name)

    threads = [threading.Thread(target=held, args=(k, 0.2)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert order[0] == order[1] and order[2] == order[3] and order[4] == order[5]
    child = subprocess.Popen([sys.executable, "-c", f"import sys, time; sys.path[:0] = {sys.path!r}\nfrom pathlib import Path\nfrom tessera.sources.locks import locked\nwith locked(Path({str(tmp_path / 'x.lock')!r})):\n    print('in', flush=True); time.sleep(60)"], stdout=subprocess.PIPE)
    assert child.stdout.readline() == b"in\n"
    with pytest.raises(locks.Busy), locks.locked(tmp_path / "x.lock", 0.3):
        pass
    child.kill()
    child.wait()
    with locks.locked(tmp_path / "x.lock", 5):
        pass
    with locks.store_lock(spark, f"file://{tmp_path}/s", 1), pytest.raises(locks.Busy), locks.store_lock(spark, f"file://{tmp_path}/s", 0.2):
        pass
    with locks.store_lock(spark, f"file://{tmp_path}/s", 0.2):
        time.sleep(1.1)
        with locks.store_lock(spark, f"file://{tmp_path}/s", 0.2, stale=1):  # its writer is taken for dead
            pass
    locks.atomic_write(tmp_path / "a/b.txt", "é")
    assert (tmp_path / "a/b.txt").read_text() == "é" and len(list((tmp_path / "a").iterdir())) == 1


def test_one_root_has_one_name():
    held = small.registered({}, "a", "/w")
    assert small.registered(held, "a", "/w") == held and small.registered(held, "b", "/v")["active_project"] == "b"
    with pytest.raises(ValueError, match="already registered"):
        small.registered(held, "b", "/w/")


def slow_paths(edges, start, end, depth, most):
    after, out, seen, todo = {}, [], set(), [[start]]
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
    while todo and len(out) < most:
        path = todo.pop(0)
        if len(path) <= depth:
            if path[-1] == end:
                out.append(path)
            elif path[-1] not in seen:
                seen.add(path[-1])
                todo += [[*path, n] for n in after.get(path[-1], []) if n not in path]
    return out


def test_call_paths(spark):
    import random

    rng = random.Random(5)
    for k in range(4):
        edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        for start, end, depth, most in (("n0", "n5", 10, 20), ("n1", "n1", 10, 20), ("n2", "n7", 3, 20), ("n3", "n4", 10, 2)):
            assert [r.path for r in graph.call_paths(df, start, end, depth, most).collect()] == slow_paths(edges, start, end, depth, most), (k, start, end)


def test_combined_and_the_older_form(spark):
    p = Project(spark, tree.from_rows(spark, FILES))
    answers = spark.createDataFrame([("project_purpose", "to test"), ("dead_code", "none"), ("else", "x")], "what string, text string")
    row = p.combined(answers).first()
    assert row.architecture.python_files == 6 and row.files_analyzed == 6 and (row.purpose, row.dead_code, row.errors) == ("to test", "none", "")

    class Client:
        def analyze_files(self, files, types):
            return {f["rel_path"]: "seen" for f in files}

    long = {f"m{k}.py": "x = 1\n" * 40 for k in range(6)}
    p = Project(spark, tree.from_rows(spark, long))
    assert Analyzer().analyze(p).filter("said is not null").count() == 0
    assert Analyzer(Client()).analyze(p).filter("said = 'seen'").count() == 4
    stopped = Analyzer(Client())
    stopped.cancel()
    assert stopped.analyze(p).filter("said is not null").count() == 0
