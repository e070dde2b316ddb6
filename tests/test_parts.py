"""Queries that ask for some facts only, and steps that grow no faster than their input."""

from tessera.operators import extract, insights
from tessera.plans.project import Project
from tessera.sources import tree

SOURCE = '"""Doc."""\nimport os\n\n\nclass C(base.D):\n    def m(self, x=1): return f(x)\n\n\ndef g(a):\n    if a and b: return 1\n    return f"{a}"\n'


def parsed(monkeypatch):
    """What parts have been asked of a parse since."""
    asked, made = [], extract.extracted

    def extracted(sources, *args, parts=extract.PARTS, **more):
        asked.append(frozenset(parts))
        return made(sources, *args, parts=parts, **more)

    monkeypatch.setattr(extract, "extracted", extracted)
    return asked


def test_parts_of_facts_are_those_of_all():
    every = extract.facts(SOURCE)
    for part in extract.TOP_PARTS:
        found = extract.facts(SOURCE, [part])
        if part == "bodies":
            assert [b["name"] for b in found[part]] == ["g", "m"] and set(found[part][0]) == set(extract.BODY)
        else:
            assert found == {"parse_error": False, part: every[part], "error": None}
    for part, fields in extract.BODY_PARTS.items():
        assert extract.facts(SOURCE, [part])["bodies"] == [{k: b[k] for k in extract.BODY | fields} for b in every["bodies"]]
    deep = "def f():\n    a\n    b\n    return 0" + " + 1" * 1500 + "\n"
    assert extract.facts(deep, ["norm_hash"])["bodies"][0]["norm_hash"] == extract.facts(deep)["bodies"][0]["norm_hash"] != "Expr|Expr|Return"


def test_hash_is_that_of_the_function_read_again():
    import ast
    import inspect

    for module in (ast, extract, inspect):
        for f in ast.walk(ast.parse(inspect.getsource(module))):
            if isinstance(f, extract.FUNCTIONS):
                assert extract.normalized_hash(f) == extract._reread_hash(f)


def test_classes_ask_for_no_other_facts(spark, monkeypatch):
    asked = parsed(monkeypatch)
    p = Project(spark, tree.from_rows(spark, {"a.py": SOURCE}))
    assert [tuple(r) for r in p.classes().collect()] == [("a.py", "C", 5, ["base.D"])]
    assert p.classes().count() == 1 and asked == [{"classes"}]
    assert p.files.count() == 1 and p.classes().columns == ["path", "name", "lineno", "bases"] and len(asked) == 2


def test_subclasses_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(insights, "BLOCK", 3)
    rows = [(f"p{k}.py", "A" if k % 2 else "B", k, ["m.A", "B", "Z"] if k % 3 else []) for k in range(40)] + [("q.py", "Lone", 1, ["q.A"])]
    found = insights.subclass_pairs(spark.createDataFrame(rows, "path string, name string, lineno int, bases array<string>"))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.sub_path, r.sub_line, r.base, r.base_path, r.base_line) for r in found.collect())
    want = sorted((s[0], s[2], b[1], b[0], b[2]) for s in rows for x in s[3] for b in rows if b[1] == x.split(".")[-1])
    assert got == want and len({r.base_path for r in found.collect()}) == 40


def test_each_table_asks_for_its_own_facts(spark, monkeypatch):
    asked = parsed(monkeypatch)
    files = {"p/a.py": SOURCE, "p/b.py": "import p.a\n" + SOURCE}
    new = lambda: Project(spark, tree.from_rows(spark, files))
    made = [
        (lambda p: p.twin_members(), {"bodies", "norm_hash"}), (lambda p: p._imports(), {"imports"}), (lambda p: p.import_edges, {"module_imports", "relative_imports"}),
        (lambda p: p.functions_ast("branches"), {"bodies", "branches"}), (lambda p: p.symbols(), {"classes", "functions"}), (lambda p: p.callgraph(), {"bodies", "callees"}),
        (lambda p: p.call_stats(), {"bodies", "callees"}), (lambda p: p.issues().union(p.issues()), {"doc", "imports", "classes", "functions", "statements", "names", "branches", "risks", "dynamic"}),
        (lambda p: p.stats(), {"is_entry", "classes", "functions"}), (lambda p: p.hint_coverage(), {"bodies"}),
    ]
    for make, parts in made:
        p, every = new(), new()
        every.files.count()
        del asked[:]
        rows = make(p)
        assert sorted(map(str, rows.collect())) == sorted(map(str, make(every).select(rows.columns).collect()))
        assert asked == [parts]


def test_all_members_of_twins(spark, tmp_path):
    from tessera.plans import source_queries

    spark.createDataFrame([(k, "red ring", 3 + k % 2) for k in range(40)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = source_queries.source_twins(spark, str(tmp_path)).filter("method = 'kinds'").collect()
    assert len(rows) == len({r.member for r in rows}) == rows[0].n == 36


def test_calls_are_counted_without_lists(spark):
    from tessera.operators import graph

    calls = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "x"), ("c", "b"), ("z", "a")], "caller string, callee string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "name string")
    made = graph.callers(calls, nodes)
    assert graph.call_counts(calls, nodes).collect() == graph.call_stats(made).collect()
    none = nodes.limit(0)
    assert graph.call_counts(calls, none).collect() == graph.call_stats(graph.callers(calls, none)).collect()


def test_equal_pieces_are_parsed_once(monkeypatch):
    parts, own = ["imports", "module_imports", "relative_imports", "classes", "functions", "callees", "is_entry"], "from .b import c\nimport m%d\n\n\n"
    shared = 'class C(b.D):\n    """A\n\ndef no(): pass\n"""\n    class E:\n        def deep(self): return h(1)\n\n@d\ndef f(a=1):\n    from ..x import y\n    return g(a)\n\nif __name__ == "__main__":\n    f()\nelse:\n    def late(): import z\n'
    sources = [own % k + shared for k in range(9)]
    want, read = [extract.facts(s, parts) for s in sources], []
    parse = extract._read
    monkeypatch.setattr(extract, "_read", lambda text: read.append(text) or parse(text))
    known = {}
    assert [extract.facts(s, parts, known) for s in sources] == want
    assert "".join(read).count("class C") == 1 and sum("import m" in t for t in read) == 9
    assert [b["line"] for b in want[0]["bodies"]] == [14, 21, 11]  # in breadth, and by the lines of the whole


def test_pieces_give_what_the_whole_gives():
    import itertools

    texts = ['"""a\n\ndef x():\n"""\n', "x = [\n\nfor_]\n", "if a: pass\nelif b:\n    from . import c\n\nelse:\n    import k\n\n", "a = 1 \\\n\nb = 2\n", "@d\n\n@e(\n1)\nasync def q(): p()\n", "\ufeff", "def (\n", "try:\n    import z\n\nfinally: pass\n", "import r\r\n", "def f(a):\n    return g(a)\n\nx = 1\n", "match q:\n    case 1:\n        def m(): pass\n\n", "\tbad\n"]
    known = {}
    for some in itertools.product(texts, repeat=3):
        assert extract.facts("".join(some), extract.OF_PIECES, known) == extract.facts("".join(some), extract.OF_PIECES)


def test_shapes_ask_for_no_other_facts_and_are_dealt_out(spark, monkeypatch, tmp_path):
    from tessera.plans import source_queries

    asked = parsed(monkeypatch)
    spark.createDataFrame([(k, "red ring", 3 + k % 2) for k in range(60)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert source_queries.source_shapes(spark, str(tmp_path)).count() == 60
    assert asked == [{"imports", "module_imports", "classes", "functions", "callees"}]
    assert source_queries.shapes(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cycles_are_found_without_the_driver(spark, monkeypatch):
    from tessera.operators import graph, joins
    from tessera.plans import project

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []
    for module in (graph, joins, project):
        monkeypatch.setattr(module, "cut", lambda df, whole=module.cut: plans.append(plan(df)) or whole(df))
    monkeypatch.setattr(graph, "SMALL", 0)
    pairs = {f"p/{a}{k}.py": f"import p.{b}{k}\nimport p.{a}{k - k % 3}\n" for k in range(12) for a, b in ("xy", "yx")}
    p = Project(spark, tree.from_rows(spark, pairs))
    found = p.import_cycles()
    plans.append(plan(found))
    assert len(plans) > 9 and not [x for x in plans if "Broadcast" in x]
    assert "rangepartitioning(members#" in plans[-1] and "[0] ASC" in plans[-1]
    rows = [r.members for r in found.collect()]
    assert rows == sorted(rows) and [f"p/{a}{k}.py" for a in "xy" for k in (0,)] == rows[0]
    assert sorted(m for r in rows for m in r) == sorted(pairs)


ALIKE = '"""Part %d: new.\n\nMore.\n"""\nimport b%d.p%d, os\nfrom ..b3 import p0%d\n\n\nclass C%d(b.D1):\n    @d("%d", -%d)\n    def m(self, k=%d): return f9(k) + f10(k) + p%d.run()\n\n\ndef g(a, b=%d):\n    if a: return b%d + %d\n'


def test_pieces_equal_but_for_numbers_are_parsed_once(monkeypatch):
    parts = ["doc", "imports", "module_imports", "relative_imports", "classes", "functions", "callees", "statements", "names", "branches", "is_entry"]
    sources = [ALIKE % tuple((7 * k * i) % 101 for i in range(12)) for k in range(30)]
    want, read = [extract.facts(s, parts) for s in sources], []
    parse = extract._read
    monkeypatch.setattr(extract, "_read", lambda text: read.append(text) or parse(text))
    known, alike = {}, {}
    assert [extract.facts(s, parts, known, alike) for s in sources] == want and len({str(w) for w in want}) == 30
    assert len(read) == 3 and not known
    assert extract.facts(sources[4], ["norm_hash"], {}, {}) == extract.facts(sources[4], ["norm_hash"])


def test_numbers_that_say_more_are_not_alike():
    texts = ["tol=1e-12, rel=1E+7", "a=1.e5, b=0x10, c=0b10, d=0o17, e=00", "a=1_000, b=5., c=.5, d=5j", "a='\\x41 5\\101', b=5", "a='5\\t6', b=5", "a='''\t5\tx''', b=5", "a='٣ 3', b=3", f"a={extract.HEAD}00012, b=5", "a=f'{x5:5} {7!r:>8} {y=}', b=b'5' b'06'", "a='9' '9' '173', b=5", "a=12345678901234567890, b=0", "a=x.e5 .f6, b=5 .real"]
    known, alike = {}, {}
    for text in texts:
        for n in (5, 6, 40, 0):
            source = f'"""Part {n}."""\n\n\n@d{n}({text})\nclass E{n}(f({text})):\n    def m{n}(self, {text if "," in text else "a=5"}): return g{n}(z{n})\n\n\nx = 1\n'
            assert extract.facts(source, extract.AS_WRITTEN, known, alike) == extract.facts(source, extract.AS_WRITTEN), text
    assert extract.marked("p5 = 60\n") == ("p9173500002 = 9173500012\n", ["5", "60"]) and extract.marked("1e-5") == ("1e-5", [])


def test_doc_of_pieces_and_pieces_that_are_no_python(monkeypatch):
    end = "\n\nclass C: pass\n\ndef f(): pass\n"
    for head in ('"""A\n\nb"""\n', "# none\n\nimport os\n\n'b'\n", "\n\n# late\n\ndef g(): 'no'\n", "# late\n\n@d\ndef g(): pass\n", "'a' 'b'\n\n'c'\n", "f'{a}'\n", "", "'''  \n\n x'''\n", "x = '''\n\ndef g(): pass\n'''\n"):
        assert extract.facts(head + end, ["doc"], {}, {}) == extract.facts(head + end, ["doc"])
    read, parse = [], extract._read
    monkeypatch.setattr(extract, "_read", lambda text: read.append(text) or parse(text))
    known = {}
    assert extract.facts(SOURCE + "\n\ndef (\n", ["doc", "is_entry"], known) == {"parse_error": True, "error": None, "is_entry": False}
    assert not any("class C" in t and "def (" in t for t in read)
    assert extract.facts("x = '''\n\ndef (\n'''\n", ["doc"], known)["parse_error"] is False


def test_a_client_asks_for_what_its_rows_say(spark, monkeypatch):
    class Client:
        def analyze_files(self, files, types):
            return {f["rel_path"]: f"{f['doc']} {f['classes']} {f['functions']} {f['imports']} {f['lines']}" for f in files}

    source = SOURCE + "\n" * 30
    p = Project(spark, tree.from_rows(spark, {"a.py": source, "b.py": "def (\n"}))
    p.files.count()
    want = sorted(map(tuple, p.analyze(Client()).collect()))
    asked = parsed(monkeypatch)
    got = Project(spark, tree.from_rows(spark, {"a.py": source, "b.py": "def (\n"})).analyze(Client())
    assert sorted(map(tuple, got.collect())) == want and want[0][-2] == "Doc. ['C'] ['g'] ['os'] 42"
    assert asked == [{"doc", "imports", "classes", "functions"}]


def test_descriptions_ask_for_docs_alone(spark, monkeypatch, tmp_path):
    from tessera.plans import state_queries

    asked = parsed(monkeypatch)
    spark.createDataFrame([(k, "red ring", 3 + k % 2) for k in range(60)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.path: r.about for r in state_queries.described_files(spark, str(tmp_path)).collect()}
    assert len(found) == 60 and (found["b2/p9.py"], found["b4/p4.py"], found["b6/p13.py"]) == ("said of 9", "Part 4: red ring.", "")
    assert asked == [{"doc"}]


def test_classes_of_sources_that_differ_by_numbers_need_few_parses(spark, monkeypatch, tmp_path):
    from tessera.plans import source_queries

    spark.createDataFrame([(k, "red ring", 3 + k % 2) for k in range(240)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    texts = [r.source_code for r in tree.split(source_queries.sources(spark, str(tmp_path)))[0].collect()]
    want, read, parse = [extract.facts(t, ["classes"]) for t in texts], [], extract._read
    monkeypatch.setattr(extract, "_read", lambda text: read.append(text) or parse(text))
    known, alike = {}, {}
    assert [extract.facts(t, ["classes"], known, alike) for t in texts] == want and sum(w["parse_error"] for w in want) == 24
    assert len(texts) == 240 and len({t for t in texts}) == 240 and len(read) < 30
