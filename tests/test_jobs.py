"""The jobs: whole runs, runs again, runs over growing input, runs that broke off, and the command line."""

import hashlib
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import changes, health
from jobs.common import read_config

DOCUMENTS = "doc_id long, text string, lang string, source string"
ROOT = Path(__file__).resolve().parent.parent


def put(spark, rows, folder):
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(df):
    return sorted(map(str, df.collect()))


# ---- health


def reported(spark, output):
    return [rows_of(t) for t in health.written(spark, output)]


def test_health_finds_what_is_there(spark, tmp_path):
    rows = [(1, "x\n" * 250, "en", "a"), (2, "ok\n  # TODO later \nfix", "en", "a"), (3, "token = 'x' key='y'", "de", "b"), (4, "ok\n  # TODO later \nfix", "de", "b"), (5, None, None, None), (6, "", "fr", "c")]
    put(spark, rows, tmp_path / "in")
    config = read_config(spark, None, "health")
    health.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    first = reported(spark, f"{tmp_path}/out")
    found = {(r.path, r.type, r.detail, r.line, r.priority) for r in health.written(spark, f"{tmp_path}/out")[1].collect()}
    assert found == {
        ("a/en/1", "buyuk_dosya", "251 lines", None, 47), ("a/en/2", "fix_tag", "TODO: # TODO later", 2, 21), ("b/de/4", "fix_tag", "TODO: # TODO later", 2, 21), ("b/de/4", "copy", "of a/en/2", None, 41),
        ("b/de/3", "fix_tag", "TOKEN: token = 'x' key='y'", 1, 21), ("b/de/3", "security_hardcoded_secret", "2 times", None, 1061),
        (None, "summary", "2 files, 254 lines, 2 findings, 0 critical", None, 0), (None, "summary", "2 files, 4 lines, 4 findings, 1 critical", None, 0),
        (None, "summary", "1 files, 1 lines, 0 findings, 0 critical", None, 0),
    }
    assert sorted(p.name for p in (tmp_path / "out/report").glob("area=*")) == ["area=_root", "area=a", "area=b", "area=c"]
    health.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    assert reported(spark, f"{tmp_path}/out") == first


def test_health_of_some_areas_leaves_the_others(spark, tmp_path):
    put(spark, [(1, "todo", "en", "a"), (2, "hack", "en", "b"), (3, "fine", "en", "c")], tmp_path / "one")
    put(spark, [(1, "done", "en", "a"), (2, "nothing", "en", "b"), (4, "hack", "en", "b")], tmp_path / "two")
    config = read_config(spark, None, "health")
    health.run(spark, f"{tmp_path}/one", f"{tmp_path}/out", config)
    health.run(spark, f"{tmp_path}/two", f"{tmp_path}/out", config | {"areas": ["b"]})
    said = {(r.path, r.detail) for r in health.written(spark, f"{tmp_path}/out")[1].collect() if r.path}
    assert said == {("a/en/1", "TODO: todo"), ("b/en/4", "HACK: hack")}
    health.run(spark, f"{tmp_path}/two", f"{tmp_path}/out", config)  # the whole: area c is gone
    files, report = health.written(spark, f"{tmp_path}/out")
    assert {r.area for r in files.collect()} == {r.area for r in report.collect()} == {"a", "b"}


def test_health_of_an_empty_table_and_odd_paths(spark, tmp_path):
    put(spark, [], tmp_path / "none")
    config = read_config(spark, None, "health")
    health.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", config)
    assert [t.count() for t in health.written(spark, f"{tmp_path}/out")] == [0, 0]
    put(spark, [(1, "x", "en", ""), (2, "x", "en", "2024"), (2, "x", "en", "2024")], tmp_path / "odd")
    health.run(spark, f"{tmp_path}/odd", f"{tmp_path}/out", config)
    files, report = health.written(spark, f"{tmp_path}/out")
    assert sorted(r.area for r in files.collect()) == ["2024", "2024", "_root"]
    assert sorted(r.path for r in report.filter("type = 'copy'").collect()) == ["2024/en/2"] * 2


def test_configs(spark, tmp_path):
    (tmp_path / "own.json").write_text('{\n"large": 3,\n "areas": ["a"]\n}')
    assert read_config(spark, f"{tmp_path}/own.json", "health") == read_config(spark, None, "health") | {"large": 3, "areas": ["a"]}
    (tmp_path / "bad.json").write_text('{"largest": 3}')
    with pytest.raises(ValueError, match="largest"):
        read_config(spark, f"{tmp_path}/bad.json", "health")


# ---- changes


def followed(batches):
    """What the change log should be, batch by batch."""
    known, out = {}, []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for number, rows in enumerate(batches):
        now = {}
        for i, text, lang, source in rows:
            path = "/".join(str(x) for x in (source, lang, i) if x is not None)
            now[path] = max(now.get(path, ("", "")), (sha(text or ""), text or ""))
        new = {p: v for p, v in now.items() if known.get(p) != v[0]}
        for path, (digest, text) in new.items():
            before = sorted(p for p, d in known.items() if d == digest and p not in new)
            here = sorted(p for p, v in new.items() if v[0] == digest)
            first = (before or here)[0]
            out.append((number, path, "modified" if path in known else "added", text.count("\n") + 1, first if text and first != path else None))
        known |= {p: v[0] for p, v in new.items()}
    return sorted(map(str, out))


def logged(spark, output):
    return sorted(str((r.batch, r.path, r.status, r.lines, r.copy_of)) for r in changes.written(spark, output).collect())


def random_batches(seed, n):
    rng = random.Random(seed)
    one = lambda: (rng.randrange(12), rng.choice(["", None, "a", "b\nc", "d\n", f"x{rng.randrange(5)}"]), rng.choice(["en", None]), rng.choice("st"))
    return [[one() for _ in range(rng.randint(0 if k else 1, 15))] for k in range(n)]


def test_changes_over_growing_input(spark, tmp_path):
    """A run takes what is there; a second one over more takes only that; one over no more writes nothing."""
    config = read_config(spark, None, "changes")
    batches = [b for b in random_batches(3, 5) if b]
    for k, rows in enumerate(batches):
        put(spark, rows, tmp_path / "in")
        changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", config)
        assert logged(spark, f"{tmp_path}/out") == followed(batches[: k + 1])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", config)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == before


def test_changes_in_many_batches_of_one_run(spark, tmp_path):
    """Whole states come every second batch, and give what all deltas would."""
    batches = [b for b in random_batches(4, 7) if b]
    for k, rows in enumerate(batches):
        put(spark, rows, tmp_path / "in")
        newest = max((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
        newest.rename(newest.with_name(f"{k:03d}.parquet"))
    config = read_config(spark, None, "changes") | {"files_per_batch": 1, "whole_every": 2}
    changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", config)
    assert logged(spark, f"{tmp_path}/out") == followed(batches)


def test_changes_that_broke_off(spark, tmp_path, monkeypatch):
    """A batch that fails between its two tables is run again, and leaves what a whole one would."""
    config = read_config(spark, None, "changes")
    batches = [b for b in random_batches(5, 3) if b]
    put(spark, batches[0], tmp_path / "in")
    changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", config)
    put(spark, batches[1], tmp_path / "in")
    whole, place = changes.take, f"{tmp_path}/out"

    def broken(batch, number, output, settings):
        changes.compare(changes.latest(changes.as_files(batch, settings)), changes.state(batch.sparkSession, output, number, settings["whole_every"])).write.parquet(f"{output}/changes/batch={number}")
        raise OSError("lost")

    monkeypatch.setattr(changes, "take", broken)
    with pytest.raises(Exception, match="lost"):
        changes.run(spark, f"{tmp_path}/in", place, f"{tmp_path}/mark", config)
    monkeypatch.setattr(changes, "take", whole)
    changes.run(spark, f"{tmp_path}/in", place, f"{tmp_path}/mark", config)
    assert logged(spark, place) == followed(batches[:2])
    with pytest.raises(ValueError, match="checkpoint"):
        changes.run(spark, f"{tmp_path}/in", place, f"{tmp_path}/other", config)


def test_changes_of_nothing(spark, tmp_path):
    put(spark, [], tmp_path / "in")
    changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", read_config(spark, None, "changes"))
    assert changes.written(spark, f"{tmp_path}/out").count() == 0


# ---- the command line


@pytest.mark.parametrize("job", ["health", "changes"])
def test_command_line(spark, tmp_path, job):
    put(spark, [(1, "todo\n", "en", "a"), (2, "todo\n", "en", "a")], tmp_path / "in")
    (tmp_path / "own.json").write_text(json.dumps({"path": ["source", "doc_id"]}))
    more = ["--checkpoint", f"{tmp_path}/mark"] if job == "changes" else []
    call = [sys.executable, "-m", f"jobs.{job}", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json", *more]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK")})
    assert "read 2 " in done.stderr and "wrote 2 " in done.stderr
    found = health.written(spark, f"{tmp_path}/out")[0] if job == "health" else changes.written(spark, f"{tmp_path}/out")
    assert sorted(r.path for r in found.collect()) == ["a/1", "a/2"]
