"""Reports as rows: order, limits, and files that Spark writes."""

import pytest
from pyspark.sql import functions as F
from state_cases import literal

from tessera.plans import lines, reports
from tessera.plans.store import write_reports
from tessera.plans.tables import cut
from tessera.sources import project as small


def files(folder):
    return {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_files_are_what_the_texts_say(spark, tmp_path):
    p, none = literal(spark), spark.createDataFrame([], "path string, description string")
    want, warnings = reports.knowledge_base(p, none, {"boot_chain": {"one": 1}}, small.DEFAULTS)
    (tmp_path / "kb/subsystems").mkdir(parents=True)
    (tmp_path / "kb/subsystems/gone.md").write_text("old")
    (tmp_path / "kb/own.txt").write_text("stays")
    rows = cut(reports.knowledge_rows(p, none, {"boot_chain": {"one": 1}}, small.DEFAULTS))
    for _ in range(2):  # a second run gives the same files
        names, said = write_reports(f"file://{tmp_path}/kb", rows, {"a": "ü"})
        assert names == sorted([*want, "meta.draft.json"]) and said == warnings
        got = files(tmp_path / "kb")
        assert got.pop("meta.draft.json") == '{\n  "a": "ü"\n}\n' and got.pop("own.txt") == "stays"
        assert got == want
    (tmp_path / "kb/meta.draft.json").write_text("edited")
    write_reports(f"file://{tmp_path}/kb", rows, {"a": "b"})
    assert (tmp_path / "kb/meta.draft.json").read_text() == "edited"
    assert want["subsystems/lib.md"].startswith("# lib\n\nFiles: 2 | Lines: 11\n\nQuality avg (0-40): **")


def test_no_text_reaches_the_driver(spark, tmp_path, monkeypatch):
    rows = lines.made(spark.range(2000), "big.md", 0, F.repeat(F.lit("x"), 100), lines.number("id")).unionByName(lines.fixed(spark, "small.md", 0, "y"))
    kind, seen = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: seen.append(df.columns) or collect(df))
    assert lines.write(rows, f"file://{tmp_path}/out", warn_mb=0.1) == (["big.md", "small.md"], ["big.md has 0.19 MB, over 0.1 MB"])
    assert seen and all("piece" not in c and "text" not in c for c in seen)
    assert (tmp_path / "out/big.md").read_text() == ("x" * 100 + "\n") * 2000


def test_a_report_over_the_limit_leaves_the_old_files(spark, tmp_path):
    good = lines.fixed(spark, "a.md", 0, "one")
    lines.write(good, str(tmp_path / "out"))
    large = lines.made(spark.range(3000), "b.md", 0, F.repeat(F.lit("x"), 100))
    with pytest.raises(lines.TooLarge, match="b.md has 0.29 MB, over 0.1 MB"):
        lines.write(large.unionByName(lines.fixed(spark, "a.md", 0, "two")), str(tmp_path / "out"), block_mb=0.1, purge=True)
    assert files(tmp_path / "out") == {"a.md": "one\n"}
    with pytest.raises(reports.TooLarge):
        lines.one(large, 0.1)


def test_order_and_edges(spark):
    rows = spark.createDataFrame([(10, "c"), (9, None), (-0, ""), (9, "b"), (9, "b")], "n long, t string")
    got = lines.one(lines.union(lines.fixed(spark, "r", 2, "end"), lines.made(rows, "r", 1, F.col("t"), lines.number("n"), "t"), lines.fixed(spark, "r", 0, "head", "")))
    assert got == "head\n\n\n\nb\nb\nc\nend\n"
    none = lines.made(rows.limit(0), "r", 1, F.col("t"))
    assert lines.one(lines.union(lines.section(none, "r", 0, "title"), lines.otherwise(none, "r", 3, "nothing"))) == "nothing\n"
    assert lines.one(lines.inline(rows.limit(0), "r", 0, "t", "All: ")) == "All: -\n"
    assert lines.one(lines.inline(rows.filter("t <> ''"), "r", 0, "t", "All: ")) == "All: b, c\n"


def test_twins_of_many_members(spark):
    from tessera.plans.project import Project
    from tessera.sources import tree

    body = "\n    b = a + 1\n    c = b\n    return c\n"
    tree_ = {f"m/f{k:03d}.py": f"def f{k}(a):{body}" for k in range(120)} | {"t.py": "# TODO x\n" * 25}
    text = reports.issues_report(Project(spark, tree.from_rows(spark, tree_)))
    [line] = [x for x in text.split("\n") if x.startswith("- TG-001")]
    assert line.split("%): ")[1] == ", ".join(f"m/f{k:03d}.py:1" for k in range(120))
    assert "### Fix/TODO tags (25)" in text and "- `t.py:20` [TODO] " in text and "- ... (5 more)\n\n## Manual" in text and "t.py:21`" not in text
