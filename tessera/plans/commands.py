"""The commands of a knowledge base: python -m tessera COMMAND [--project NAME] [--json].

A project is a root with a settings file, and a store beside it; a registry names
the projects and which of them is active. Each command gives rows, or one mapping,
printed as text or, with --json, as one JSON document on the standard output.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, snapshots
from ..sources import git, health
from ..sources import project as small
from ..sources.locks import atomic_write, locked
from . import lines, reports
from .project import Project
from .store import DESCRIPTION, FACT, Store, debt, new_code, stored_impact, sync, write_reports
from .tables import scratch

#: Where a project keeps what belongs to it, below its root.
FOLDER = ".tessera"


class Place:
    """A project as the commands see it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.base = spark, root, Path(root) / FOLDER
        self.settings = small.load_settings(self.base / "settings.json")
        self.store = Store(spark, f"file://{self.base}/store")
        self.state_file = self.base / "state.json"

    def project(self, fresh: bool = False) -> Project:
        return Project.at(self.spark, f"file://{self.root}", self.settings["ignore_dirs"], None if fresh else self.store.read("facts", FACT))

    def notes(self) -> dict:
        return small.load_yaml(self.base / "meta.yaml")

    def state(self) -> dict:
        return small.load_state(self.state_file)

    def views(self, p: Project) -> list[str]:
        """The views of the state, which every command that changes it writes anew."""
        made = reports.view_rows(p, self.settings["project_name"] or Path(self.root).name, self.root, now(), self.state(), self.settings, small.load_json(self.base / "health.json"))
        return lines.write(made, f"file://{self.base}/state", self.settings["output_block_mb"], self.settings["output_warn_mb"])[0]


def now() -> str:
    return datetime.now().isoformat(timespec="seconds")


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def init(args, registry: Path, spark) -> dict:
    """Registers a root under a name, writes its settings, and makes what is missing of a plain project."""
    root = str(Path(args.project_root or ".").resolve())
    name = (args.project_name or Path(root).name).strip().lower().replace(" ", "-")
    with locked(registry.with_suffix(".lock")):
        held = small.registered(small.load_json(registry), name, root)
        atomic_write(registry, json.dumps(held, indent=2, ensure_ascii=False))
    chosen = {"project_name": name, "project_root": root, "env_path": args.env_path or "", "ignore_dirs": args.ignore_dirs, "big_file_threshold": args.big_file_threshold, "created_at": now()}
    atomic_write(Path(root) / FOLDER / "settings.json", json.dumps(small.DEFAULTS | chosen, indent=2, ensure_ascii=False))
    return {"status": "ok", "project": name, "root": root, "made": scaffold(root, name)}


def scaffold(root: str, name: str) -> list[str]:
    """Writes a .gitignore and a pyproject.toml where there is none; what is there stays."""
    texts = {".gitignore": "__pycache__/\n*.pyc\n.venv/\n" + FOLDER + "/\n", "pyproject.toml": f'[project]\nname = "{name}"\nversion = "0.1.0"\ndependencies = []\n'}
    made = [f for f in texts if not (Path(root) / f).exists()]
    for f in made:
        atomic_write(Path(root) / f, texts[f])
    return made


def run_sync(place: Place, label: str = "sync", fresh: bool = False) -> dict:
    diff = sync(place.spark, f"file://{place.root}", place.store, place.settings, place.notes(), f"file://{place.base}/KB", label, fresh)
    areas, twins = new_code(place.spark, f"file://{place.root}", place.store, diff, place.settings)
    place.views(place.project())
    n = {r.status: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {k: n.get(k, 0) for k in ("added", "deleted", "modified", "moved")} | {"new_areas": [r.area for r in areas.collect()], "new_twins": rows(twins)}


def check(place: Place) -> dict:
    """Tries to import every module in the project's interpreter, and keeps what came of it."""
    p = place.project()
    lines = health.probe(place.spark, place.root, p.modules(), place.settings["env_path"])
    found = p.health(lines).orderBy("subsystem").collect()
    summary = {k: sum(r[k] for r in found) for k in ("ok", "failed", "expected")}
    out = {"summary": {"ok": summary["ok"], "fail": summary["failed"], "expected": summary["expected"]}, "by_subsystem": {r.subsystem: r.asDict() for r in found}, "failing": [r.line for r in lines.filter(F.startswith("line", F.lit("FAIL"))).collect()]}
    atomic_write(place.base / "health.json", json.dumps(out, indent=2, ensure_ascii=False))
    place.views(p)
    return out


def changed(place: Place) -> dict:
    """Files and symbols changed since the last commit; without git, files since the last fingerprint."""
    p = place.project()
    if git.is_repository(place.root):
        files = git.status(git.text_lines(place.spark, git.run(place.root, "status", "--porcelain") or ""))
        lines = git.changed_lines(git.text_lines(place.spark, git.run(place.root, "diff", "--unified=0", "HEAD") or git.run(place.root, "diff", "--unified=0") or ""))
        return {"source": "git", "files": rows(files.orderBy("path")), "symbols": rows(p.changed_symbols(lines).orderBy("path", "line"))}
    files = snapshots.changed_since(p.fingerprint, place.store.fingerprint(place.store.last()))
    return {"source": "fingerprint", "files": rows(files.orderBy("path")), "symbols": []}


def close_task(place: Place, args) -> dict:
    with locked(place.base / "state.lock"):
        state = small.close_task(place.state(), args.name or place.state()["active_task"] or "(unnamed)", args.summary or "", now())
        atomic_write(place.state_file, json.dumps(state, indent=2, ensure_ascii=False))
    place.views(place.project())
    return state


def describe(place: Place, args) -> object:
    if args.path == "list":
        return rows(place.store.descriptions().orderBy("path"))
    if args.text:
        place.store.describe(args.path, " ".join(args.text))
    found = place.store.read("descriptions", DESCRIPTION).filter(F.col("path") == args.path)
    return rows(found) or {"error": "not_found", "path": args.path}


def report(place: Place) -> dict:
    rows = reports.knowledge_rows(place.project(), place.store.descriptions(), place.notes(), place.settings)
    made, warnings = write_reports(f"file://{place.base}/KB", rows, settings=place.settings)
    return {"reports": made, "warnings": warnings}


def techdebt(place: Place) -> dict:
    debt(place.spark, f"file://{place.root}", place.store, place.settings)
    p = place.project()
    return {"twin_groups": p.twins().count(), "fix_tags": p.fix_tags().count()} | rows(p.call_stats())[0]


def scan(place: Place, args) -> dict:
    p = place.project(args.no_cache)
    place.store.write("facts", p.facts)
    return rows(p.stats())[0] | {"quality": rows(quality.summary(p.judged()))[0]}


def impact(place: Place, args) -> list[dict]:
    """From the edges that are kept, or from the tree where none are."""
    if place.store.last() >= 0:
        where = place.project().locate(args.file).first()
        return rows(stored_impact(place.store, where.path if where else args.file).withColumnRenamed("node", "path").orderBy("role", "path"))
    return rows(place.project().impact(args.file).orderBy("role", "path"))


COMMANDS = {
    "scan": scan, "sync": lambda p, a: run_sync(p, fresh=a.no_cache), "rescan": lambda p, a: run_sync(p, "rescan", True), "report": lambda p, a: report(p), "find": lambda p, a: rows(p.project().find(a.symbol)), "outline": lambda p, a: rows(p.project().outline(a.file)),
    "impact": impact, "check": lambda p, a: check(p), "techdebt": lambda p, a: techdebt(p), "desc": describe, "changed": lambda p, a: changed(p), "close-task": close_task, "scaffold": lambda p, a: {"made": scaffold(p.root, p.settings["project_name"] or Path(p.root).name)},
}
#: Commands that print no JSON, as they only write files.
QUIET = ("sync", "rescan", "report")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("init", "list", "select", "current", *COMMANDS):
        p = sub.add_parser(name)
        if name not in QUIET:
            p.add_argument("--json", action="store_true")
        if name in COMMANDS or name == "current":
            p.add_argument("--project")
    sub.choices["init"].add_argument("--project-root")
    sub.choices["init"].add_argument("--project-name")
    sub.choices["init"].add_argument("--env-path")
    sub.choices["init"].add_argument("--ignore-dirs", nargs="*", default=[])
    sub.choices["init"].add_argument("--big-file-threshold", type=int, default=small.DEFAULTS["big_file_threshold"])
    sub.choices["select"].add_argument("name")
    for name in ("scan", "sync", "rescan"):
        sub.choices[name].add_argument("--no-cache", action="store_true")
    sub.choices["find"].add_argument("symbol")
    sub.choices["outline"].add_argument("file")
    sub.choices["impact"].add_argument("file")
    sub.choices["close-task"].add_argument("--name")
    sub.choices["close-task"].add_argument("--summary")
    sub.choices["desc"].add_argument("path")
    sub.choices["desc"].add_argument("text", nargs="*")
    return out


def text(value, pad: str = "") -> str:
    return "\n".join(pad + line for line in reports.bullets(value))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, registry: str | None = None) -> int:
    args = parser().parse_args(argv)
    kept = Path(registry or os.environ.get("TESSERA_REGISTRY") or Path.home() / ".tessera-registry.json")
    try:
        out = _answer(args, kept, spark)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False) if getattr(args, "json", False) else text(out))
    return 0


def _answer(args, kept: Path, spark: SparkSession | None):
    held = small.load_json(kept)
    if args.command == "init":
        return init(args, kept, spark)
    if args.command == "list":
        return [p | {"active": n == held.get("active_project")} for n, p in sorted(held.get("projects", {}).items())]
    if args.command == "select":
        if args.name not in held.get("projects", {}):
            raise ValueError(f"no project {args.name!r}")
        with locked(kept.with_suffix(".lock")):
            atomic_write(kept, json.dumps(small.load_json(kept) | {"active_project": args.name}, indent=2, ensure_ascii=False))
        return held["projects"][args.name]
    name = small.resolve(held, args.project, os.getcwd())
    if name not in held.get("projects", {}):
        raise ValueError(f"no project {name!r}; init makes one")
    if args.command == "current":
        return held["projects"][name]
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    with scratch(spark):
        return COMMANDS[args.command](Place(spark, held["projects"][name]["root"]), args)
