"""Reports as rows of lines, made where the data are. The headings are fixed texts.

The functions whose names end in _rows give what `lines.write` writes without the driver
seeing it; those of the same name without it give the text, for a caller who asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import quality
from . import lines
from .lines import MB, TooLarge
from .project import Project
from .tables import cut


class BrokenContract(ValueError):
    pass


def sizes(texts: DataFrame, warn_mb: float = 1, block_mb: float = 5) -> DataFrame:
    """texts: name, text. name, megabytes, and state: ok, warn or block."""
    mb = names.megabytes("text")
    return texts.select("name", mb.alias("megabytes"), F.when(mb > block_mb, "block").when(mb > warn_mb, "warn").otherwise("ok").alias("state"))


def guarded(text: str, name: str, warn_mb: float = 1, block_mb: float = 5) -> tuple[str, str | None]:
    """The text, and a warning if it is large. Texts over the limit are an error, before anything is written."""
    size = len(text.encode()) / MB
    if size > block_mb:
        raise TooLarge(f"{name} has {size:.2f} MB, over {block_mb} MB")
    return text, f"{name} has {size:.2f} MB, over {warn_mb} MB" if size > warn_mb else None


def require(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """df, if it has the columns with these types."""
    have = dict(df.dtypes)
    wrong = [f"{c} {have.get(c)} instead of {t}" for c, t in columns.items() if have.get(c) != t]
    if wrong:
        raise BrokenContract(f"{name}: {', '.join(wrong)}")
    return df


def _text(lines: list[str]) -> str:
    return "\n".join(lines) + "\n"


def described(files: DataFrame, descriptions: DataFrame) -> DataFrame:
    """files with `about`: the description given, else the first line of the doc, else nothing."""
    given = descriptions.select("path", "description")
    return files.join(given, "path", "left").withColumn("about", F.coalesce(F.nullif("description", F.lit("")), F.nullif("doc", F.lit("")), F.lit("")))


def quickref_rows(p: Project, name: str = "", root: str = "", at: str = "", info: str = "") -> DataFrame:
    spark, file = p.spark, "QUICKREF.md"
    head = ["# QUICKREF", "", f"- Project: {name}", f"- Root: {root}", f"- Generated: {at}", ""] + (["## What is this project?", "", info.strip(), ""] if info else [])
    s = p.stats().select("total_py", "total_non_py", "total_lines", "total_classes", "total_functions").first()
    head += ["## Numbers", "", f"- Python files: {s.total_py}", f"- Other files: {s.total_non_py}", f"- Lines: {s.total_lines}", f"- Classes: {s.total_classes}", f"- Module functions: {s.total_functions}", "", "## Subsystems", ""]
    areas = p.sources.select(paths.subsystem("path", None).alias("area")).filter("area is not null").groupBy("area").agg(F.count("*").alias("n"))
    entries = p.sources.filter(F.instr("path", "/") == 0).select("path")
    return lines.union(
        lines.fixed(spark, file, 0, *head),
        lines.made(areas, file, 1, F.concat(F.lit("- "), "area", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)")), "area"),
        lines.fixed(spark, file, 2, "", "## Entry points", ""),
        lines.made(entries, file, 3, F.concat(F.lit("- "), "path"), "path"),
    )


def quickref(p: Project, name: str = "", root: str = "", at: str = "", info: str = "") -> str:
    return lines.one(quickref_rows(p, name, root, at, info))


def project_map_rows(p: Project, descriptions: DataFrame) -> DataFrame:
    """The tree, folders before what they hold, each level in order of names."""
    python = described(p.files, descriptions).select("path", "lines", "about")
    other = described(p.other_files.withColumn("doc", F.lit("")), descriptions).select("path", F.lit(0).alias("lines"), "about")
    rows = python.unionByName(other)
    levels = rows.select("lines", "about", F.explode(paths.tree_rows("path")).alias("t")).select("t.*", F.when(F.col("t.is_file"), F.col("lines")).alias("lines"), F.when(F.col("t.is_file"), F.col("about")).alias("about")).distinct()
    size = F.when(F.col("lines") > 0, F.concat(F.lit("  ("), F.col("lines").cast("string"), F.lit(" lines)"))).otherwise("")
    about = F.when(F.col("about") != "", F.concat(F.lit(" — "), "about")).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.when(F.col("is_file"), F.concat(size, about)).otherwise("/"))
    file = "PROJECT_MAP.md"
    body = levels.select(F.lit(file).alias("name"), F.lit(1).alias("part"), F.split("prefix", "/").alias("order"), F.concat(line, F.lit("\n")).alias("piece"))
    return lines.fixed(p.spark, file, 0, "# Project Map", "", "Every folder and file with a one-line summary.", "").unionByName(body)


def project_map(p: Project, descriptions: DataFrame, block_mb: float = 5) -> str:
    return lines.one(project_map_rows(p, descriptions), block_mb)


def dependencies_rows(p: Project) -> DataFrame:
    file, bar = "DEPENDENCIES.md", F.lit("|")
    areas = cut(p.stats().select("subsystems"))
    into = p.dependency_matrix().groupBy(F.col("src_area").alias("area")).agg(F.map_from_entries(F.collect_list(F.struct("dst_area", F.col("n").cast("string")))).alias("into"))
    each = areas.select(F.explode("subsystems").alias("area"), "subsystems").join(into, "area", "left")
    cells = F.transform("subsystems", lambda a: F.coalesce(F.try_element_at("into", a), F.lit("-")))
    rule = F.repeat(F.lit("---|"), F.size("subsystems"))
    cycles = lines.made(p.import_cycles(), file, 4, F.concat(F.lit("- "), F.array_join("members", " <-> ")), F.array_join("members", "\n"))
    return lines.union(
        lines.fixed(p.spark, file, 0, "# Dependencies", "", "## Subsystem matrix (rows import columns)", ""),
        lines.made(areas, file, 1, F.concat(F.lit("| from \\ to |"), F.array_join("subsystems", "|"), F.lit("|\n|---|"), rule)),
        lines.made(each, file, 2, F.concat(F.lit("| "), "area", F.lit(" |"), F.array_join(cells, "|"), bar), "area"),
        lines.fixed(p.spark, file, 3, "", "## Circular imports (static)", ""),
        lines.otherwise(cut(cycles), file, 4, "- none detected"),
    )


def dependencies(p: Project) -> str:
    return lines.one(dependencies_rows(p))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """symbols with `line`: name, kind and place in columns of fixed width."""
    return symbols.withColumn("line", F.format_string("%-70s %-8s %s:%s", "name", "kind", "path", "lineno"))


def symbol_index_rows(p: Project) -> DataFrame:
    file = "SYMBOL_INDEX.md"
    body = lines.made(symbol_lines(p.symbols()), file, 1, F.col("line"), F.lower("name"), "path", lines.number("lineno"))
    return lines.fixed(p.spark, file, 0, "# Symbol Index", "", "Flat lookup: symbol -> file:line.", "").unionByName(body)


def symbol_index(p: Project, block_mb: float = 5) -> str:
    return lines.one(symbol_index_rows(p), block_mb)


def _said(value) -> Column:
    return F.col(value).cast("string") if isinstance(value, str) else value.cast("string")


def file_blocks(p: Project, descriptions: DataFrame, big: int = 800) -> DataFrame:
    """area, path, lines, line: what the report of a folder of the first level says of each file, as one text."""
    issues = p.issues().groupBy("path").agg(F.array_sort(F.collect_list(F.struct("type", "severity", "kritik", "detail", "cozum"))).alias("issues"))
    rows = described(p.having("doc", "classes", "functions"), descriptions).join(p.scores(), "path").join(issues, "path", "left").withColumn("area", paths.subsystem("path", None)).filter("area is not null")
    each = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    one = lambda *parts: F.array(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    span = lambda x: F.concat(x["lineno"].cast("string"), F.lit("-"), x["end_lineno"].cast("string"))
    about = F.when(F.col("about") != "", F.array(F.lit(""), F.concat(F.lit("> "), F.col("about")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    scores = one("- Quality: Aktiflik ", _said("aktiflik"), " | Gereklilik ", _said("gereklilik"), " | Kod Kalitesi ", _said("kod_kalitesi"), " | Butunluk ", _said("butunluk"), " | **Toplam ", _said("toplam"), "/40**")
    said = F.transform(each("issues"), lambda i: F.concat(F.lit("  - ["), F.when(i["kritik"], "KRITIK").otherwise(i["severity"]), F.lit("] "), i["type"], F.lit(": "), i["detail"], F.lit(" -> "), i["cozum"]))
    functions = F.transform(each("functions"), lambda f: F.concat(F.format_string("fn  %-30s ", f["name"]), span(f), F.lit(" "), f["sig"]))
    methods = lambda c: F.transform(c["methods"], lambda m: F.concat(F.format_string("    def %-28s ", m["name"]), span(m), F.lit(" "), m["sig"]))
    classes = F.flatten(F.transform(each("classes"), lambda c: F.concat(F.array(F.concat(F.format_string("cls %-30s ", c["name"]), span(c))), methods(c))))
    outline = F.concat(F.array(F.format_string("(%d lines - outline)", "lines"), F.lit(""), F.lit("```")), functions, classes, F.array(F.lit("```")))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(each(c), lambda x: x["name"]), ", "), F.lit("")), F.lit("-"))
    short = F.array(F.concat(F.lit("- Classes: "), listed("classes")), F.concat(F.lit("- Functions: "), listed("functions")))
    block = F.concat(one("## ", F.col("path")), about, scores, said, F.when(F.col("lines") >= big, outline).otherwise(short), F.array(F.lit("")))
    return rows.select("area", "path", "lines", F.array_join(block, "\n").alias("line"))


def subsystem_rows(p: Project, descriptions: DataFrame, big: int = 800) -> DataFrame:
    """A report for each folder of the first level."""
    blocks = cut(file_blocks(p, descriptions, big))
    sums = blocks.groupBy("area").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"))
    found = sums.join(quality.by_subsystem(p.judged()).withColumnRenamed("subsystem", "area"), "area")
    said = lambda *parts: F.concat(*[F.lit(x[1:]) if x.startswith("=") else F.col(x).cast("string") for x in parts])
    head = said("=# ", "area", "=\n\nFiles: ", "n_files", "= | Lines: ", "n_lines", "=\n\nQuality avg (0-40): **", "avg_toplam", "=** | Issues: ", "issues", "= (kritik ", "kritik", "=)\n")
    file = F.concat(F.lit("subsystems/"), "area", F.lit(".md"))
    return lines.made(found, file, 0, head).unionByName(lines.made(blocks, file, 1, F.col("line"), "path"))


def quality_rows(p: Project) -> list:
    return quality.by_subsystem(p.judged()).orderBy("subsystem").collect()


def bullets(value, level: int = 0) -> list[str]:
    """A nested value as a list."""
    pad = "  " * level
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            out += [f"{pad}**{k}**", *bullets(v, level + 1)] if isinstance(v, dict | list) and v else [f"{pad}- **{k}**: {v}"]
        return out
    if isinstance(value, list):
        return [x for item in value for x in (bullets(item, level) if isinstance(item, dict) else [f"{pad}- {item}"])]
    return [f"{pad}- {value}"]


#: Reports of flows, and the part of the notes that each shows.
FLOWS = {"boot": "boot_chain", "message": "message_flow", "memory": "memory_flow", "session": "session_flow", "startup_shutdown": "startup_chain"}


def flows(notes: dict) -> dict[str, str]:
    return {n: _text([f"# {n.replace('_', ' ').title()}", "", *bullets(notes[k])]) for n, k in FLOWS.items() if notes.get(k)}


def architecture_rows(p: Project, notes: dict) -> DataFrame:
    file, out = "ARCHITECTURE.md", [""]
    areas = lines.made(p.stats().select(F.explode("subsystems").alias("area")), file, 1, F.concat(F.lit("- "), "area"), "area")
    if not notes:
        out += ["> Runtime principles not yet authored (meta.yaml).", "> Baslangic noktasi: KB/INSIGHTS.md (otomatik kesif) ve meta.draft.yaml -> bunlari duzenleyip meta.yaml olarak kaydedin."]
    layers, patterns, events, able = notes.get("architecture", {}).get("layers", []), notes.get("design_patterns", []), notes.get("events", []), notes.get("capabilities", [])
    if layers:
        out += ["## Layers", "", *[x for e in layers for x in (f"### {e.get('name', '')}", e.get("responsibility", ""), "")]]
    if patterns:
        out += ["## Design patterns", "", *[f"- **{e.get('name', '')}**: {e.get('description') or e.get('note', '')}" for e in patterns], ""]
    if events:
        out += [f"## Events ({len(events)})", "", *[f"- {e.get('name', '')}" for e in events], ""]
    if able:
        out += ["## Capabilities", "", *[f"- {e.get('capability', '')}: {e.get('component', '')}" for e in able], ""]
    return lines.union(lines.fixed(p.spark, file, 0, "# Architecture", "", "## Subsystems", ""), areas, lines.fixed(p.spark, file, 2, *out))


def architecture(p: Project, notes: dict) -> str:
    return lines.one(architecture_rows(p, notes))


def insights_rows(p: Project) -> DataFrame:
    """The hubs and base classes are a dozen and a score; entry files and layers grow with the tree."""
    spark, file = p.spark, "INSIGHTS.md"
    hubs = [f"- `{r.dst}`  ({r.in_degree} dosya tarafindan kullaniliyor)" for r in p.hubs().limit(12).collect()]
    bases = p.base_classes().collect()
    extended = [f"- `{r.base}`  tanim: {r.base_path}:{r.base_line}  alt-siniflar: " + ", ".join(f"{x.sub} ({x.sub_path}:{x.sub_line})" for x in r.first) for r in bases[:20]] + ([f"- ... +{len(bases) - 20} tane daha"] if len(bases) > 20 else [])
    entries = lines.made(p.entry_files(), file, 1, F.concat(F.lit("- `"), "path", F.lit("`")), "path")
    said = F.concat(F.lit("- **"), "area", F.lit("**  level "), F.col("level").cast("string"), F.lit("  (kullanan "), F.col("imported_by").cast("string"), F.lit(" alt-sistem, bagimli oldugu "), F.col("imports_others").cast("string"), F.lit(")"))
    layers = lines.made(p.layers(), file, 3, said, lines.number("level"))
    return lines.union(
        lines.fixed(spark, file, 0, "# INSIGHTS", "", "Otomatik kesif sonuclari (LLM gerektirmez).", "", "## Hub moduller (en cok bagimlilik alan)", "", *(hubs or ["- (yeterli bagimlilik verisi yok)"]), "", "## Entry-point dosyalar", ""),
        lines.otherwise(cut(entries), file, 1, "- (bulunamadi)"),
        lines.fixed(spark, file, 2, "", "## Katman yapisi (subsystem)", "", "Seviye 0 = digerleri tarafindan en cok kullanilan (root/kutuphane); buyuk seviye = ust katman (UI/giris)."),
        lines.otherwise(cut(layers), file, 3, "- (yeterli bagimlilik verisi yok)"),
        lines.fixed(spark, file, 4, "", "## Base-class / polymorphic harita", "", "En az 2 alt sinifi olan siniflar.", *(extended or ["- (bulunamadi)"])),
    )


def insights(p: Project) -> str:
    return lines.one(insights_rows(p))


def draft_notes(p: Project) -> dict:
    """A first version of the notes, to be edited: ten layers, entries and hubs, eight patterns."""
    return {
        "architecture": {"layers": [{"name": r.area, "responsibility": r.role, "level": r.level} for r in p.layers().orderBy("level").limit(10).collect()]},
        "entry_points": [{"name": r.path.rsplit("/", 1)[-1].removesuffix(".py"), "file": r.path, "type": "main"} for r in p.entry_files().limit(10).collect()],
        "design_patterns": [{"name": f"inheritance_{r.base}", "type": "inheritance", "note": f"Temel sinif {r.base} -> {r.n} alt sinif ({', '.join(x.sub for x in r.first[:3])})"} for r in p.base_classes().limit(8).collect()],
        "dependencies": {"hub_files": [r.dst for r in p.hubs().limit(10).collect()]},
    }


def issues_rows(p: Project, manual: list[dict] = (), failing: list[str] = ()) -> DataFrame:
    """Members of the ten first groups of twins are pieces of one line, as a group may have any number of them."""
    spark, file = p.spark, "ISSUES.md"
    cycles = lines.made(p.import_cycles(), file, 11, F.concat(F.lit("- "), F.array_join("members", " <-> ")), F.array_join("members", "\n"))
    broken = lines.made(p.files.filter("parse_error"), file, 21, F.concat(F.lit("- "), "path"), "path")
    line = F.concat(F.lit("- ["), F.when(F.col("kritik"), "KRITIK").otherwise(F.col("severity")), F.lit("] `"), "path", F.lit("` "), "type", F.lit(": "), "detail")
    found = lines.made(p.issues(), file, 31, line, F.when(F.col("kritik"), "0").otherwise("1"), "path", "type", "detail")
    marked = cut(p.fix_tags())
    n_tags = marked.count()
    tag = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` ["), "tag", F.lit("] "), F.substring("text", 1, 80))
    tags = lines.made(marked.orderBy("path", "line").limit(20), file, 51, tag, "path", lines.number("line"))
    if n_tags > 20:
        tags = tags.unionByName(lines.fixed(spark, file, 52, f"- ... ({n_tags - 20} more)"))
    parts = [lines.fixed(spark, file, 0, "# ISSUES", "", "## Auto-detected", "")]
    if failing:
        parts.append(lines.fixed(spark, file, 1, "### Failing imports (runtime health)", *[f"- {f}" for f in failing], ""))
    parts += [lines.section(cycles, file, 10, "### Circular imports (static)"), lines.section(broken, file, 20, "### Unparseable files"), lines.section(found, file, 30, "### Quality issues (by file, kritik first)")]
    parts += [lines.section(_twin_rows(p, file, 41), file, 40, "### Twin groups (potential duplicates)")]
    notes = [f"- **{i.get('title', '')}** ({i.get('severity', '?')}): {i.get('detail', '')}" for i in manual]
    return lines.union(*parts, lines.section(tags, file, 50, f"### Fix/TODO tags ({n_tags})", None), *([lines.fixed(spark, file, 53, "")] if n_tags else []), lines.fixed(spark, file, 60, "## Manual", "", *(notes or ["- (none - add via state.json)"])))


def _twin_rows(p: Project, file: str, part: int) -> DataFrame:
    groups = cut(p.twins().select("group_id", "method", F.col("similarity_avg").cast("string").alias("similarity")))
    n, first = groups.count(), groups.orderBy("group_id").limit(10)
    members = cut(p.twin_members().join(F.broadcast(first.select("group_id")), "group_id").select("group_id", "path", F.col("line").cast("long").alias("line")))
    least = members.groupBy("group_id").agg(F.min(F.struct("path", "line")).alias("least"))
    # members that stand in one place are told apart by a number, as only one of them comes first
    counted = members.groupBy("group_id", "path", "line").agg(F.count("*").alias("n")).join(F.broadcast(least), "group_id")
    here = F.concat_ws(":", "path", "line")
    said = F.when(F.struct("path", "line") == F.col("least"), F.concat(here, F.repeat(F.concat(F.lit(", "), here), (F.col("n") - 1).cast("int")))).otherwise(F.repeat(F.concat(F.lit(", "), here), F.col("n").cast("int")))
    out = lines.union(
        lines.pieces(first, file, part, F.concat(F.lit("- "), "group_id", F.lit(" ("), "method", F.lit(", sim~"), "similarity", F.lit("%): ")), "group_id", F.lit("0")),
        lines.pieces(counted, file, part, said, "group_id", F.lit("1"), "path", lines.number("line")),
        lines.pieces(first, file, part, F.lit("\n"), "group_id", F.lit("2")),
    )
    more = lines.pieces(p.spark.range(0, 1, 1, 1), file, part, F.lit(f"- ... ({n - 10} more groups)\n"), F.lit("~"))
    return out.unionByName(more) if n > 10 else out


def issues_report(p: Project, manual: list[dict] = (), failing: list[str] = (), block_mb: float = 5) -> str:
    return lines.one(issues_rows(p, manual, failing), block_mb)


def status(p: Project, name: str, at: str, state: dict, health: dict | None = None) -> str:
    s, c, q = p.stats().first(), p.call_stats().first(), quality.summary(p.judged()).first()
    health = health or {}
    out = ["# STATUS - current state (auto section regenerated; persistent fields from state.json)", "meta:", f"  project: {name}", f"  last_sync: {at}", f"  active_task: {state.get('active_task') or 'null'}"]
    out += ["metrics:", f"  python_files: {s.total_py}", f"  lines: {s.total_lines}", f"  classes: {s.total_classes}", f"  subsystems: {', '.join(s.subsystems)}", "health:", f"  ok: {health.get('ok', '?')}", f"  fail: {health.get('fail', '?')}"]
    out += ["quality:", f"  avg_score: {q.avg_toplam}", f"  total_issues: {q.total_issues}", f"  kritik: {q.kritik_issues}", "techdebt:", f"  twin_groups: {p.twins().count()}", f"  fix_tags: {p.fix_tags().count()}", f"  callgraph_funcs: {c.total_functions}", f"  callgraph_edges: {c.total_call_edges}", f"  avg_callees: {c.avg_callees_per_func}"]
    out += ["quality_by_subsystem:", *[f"  {r.subsystem}: avg {r.avg_toplam}, issues {r.issues} (kritik {r.kritik})" for r in quality_rows(p)], "top_remediation:"]
    for a in quality.top_actions(p.issues()).limit(8).collect():
        out += [f"  - [{a.severity.upper()}] {a.path}:{a.line or '?'} {a.detail}", f"      cozum: {a.cozum} (iyilestirir: {a.iyilestirilen_skor})"]
    return _text(out)


def context(state: dict) -> str:
    tasks = [x for t in state.get("last_tasks", []) for x in (f"## {t.get('date', '')} - {t.get('name', '')}", "", t.get("summary", ""), "")]
    return _text(["# CONTEXT", "", "Last tasks (newest first):", "", *(tasks or ["(none yet)"])])


def environment_rows(p: Project, root: str, settings: dict, health: dict | None = None) -> DataFrame:
    spark, file, health = p.spark, "ENVIRONMENT.md", health or {}
    return lines.union(
        lines.fixed(spark, file, 0, "# ENVIRONMENT", "", f"- Project root: {root}", f"- Python env: {settings.get('env_path') or '(auto-detect)'}", f"- Ignore dirs: {', '.join(sorted(settings.get('ignore_dirs', []))) or '-'}"),
        lines.inline(p.sources.filter(F.instr("path", "/") == 0), file, 1, "path", "- Entry points: "),
        lines.fixed(spark, file, 3, "", "## Health", "", f"- Import check: {health.get('ok', '?')} OK / {health.get('fail', '?')} FAIL"),
    )


def environment(p: Project, root: str, settings: dict, health: dict | None = None) -> str:
    return lines.one(environment_rows(p, root, settings, health))


def change_entry(diff: DataFrame, label: str, at: str) -> str:
    """An entry of the change log: the counts, and the first twenty of each kind."""
    n = {r.status: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    out = ["", f"## {at} - {label}", "", " | ".join(f"{k.title()}: {n.get(k, 0)}" for k in ("added", "deleted", "modified", "moved")).join(["- ", ""])]
    for kind, sign in (("added", "+"), ("deleted", "-"), ("moved", "~")):
        out += [f"  {sign} {f'{r.old_path} -> {r.path}' if kind == 'moved' else r.path}" for r in diff.filter(F.col("status") == kind).orderBy("path").limit(20).collect()]
    return _text(out)


def knowledge_rows(p: Project, descriptions: DataFrame, notes: dict, settings: dict) -> DataFrame:
    """The rows of all reports, by file name."""
    made = [quickref_rows(p, settings.get("project_name", "")), project_map_rows(p, descriptions), dependencies_rows(p), symbol_index_rows(p), architecture_rows(p, notes), insights_rows(p), subsystem_rows(p, descriptions, settings["big_file_threshold"])]
    return lines.union(*made, *[lines.text(p.spark, f"flows/{n}.md", t) for n, t in flows(notes).items()])


def knowledge_base(p: Project, descriptions: DataFrame, notes: dict, settings: dict) -> tuple[dict[str, str], list[str]]:
    """All reports by file name, and warnings on large ones, for a caller who asks for the texts."""
    texts, _, warnings = lines.joined(knowledge_rows(p, descriptions, notes, settings), settings["output_block_mb"], settings["output_warn_mb"])
    return {r.name: r.text for r in texts.collect()}, warnings


def view_rows(p: Project, name: str, root: str, at: str, state: dict, settings: dict, health: dict) -> DataFrame:
    """The rows of the views of a project's state. health: as kept, with a summary and the failing imports."""
    summary = health.get("summary", {})
    said = lines.text(p.spark, "STATUS.md", status(p, name, at, state, summary)).unionByName(lines.text(p.spark, "CONTEXT.md", context(state)))
    return lines.union(said, environment_rows(p, root, settings, summary), issues_rows(p, state["manual_issues"], health.get("failing", [])))
