"""Queries on sources: a Python file is made of each row of part, and the SQL says from the row what the file's facts are.

File k lies in folder b(k % 7), every fiftieth in the root. It imports the file
k // 2 by its full name, k // 3 by a relative one, and its neighbour seven places
up or down. Every tenth does not parse, some begin with a byte order mark, some
hold a byte that is no UTF-8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, insights, twins
from ..sources import git
from . import queries
from .project import Project
from .queries import query, table

HEAD = """\"\"\"Part %1$d: %2$s.

More.
\"\"\"
import os, %3$s.%4$s
import b%5$d.p%6$d
from .p%7$d import x
from ..b%8$d.p%9$d import y
from . import util
if TYPE_CHECKING:
    import typing_only
else:
    import never_loaded
try:
    import fast_%4$s
except ImportError:
    import slow


class %10$s(base.%11$s, Generic[int]):
    @property
    @cached("%1$d")
    def size(self, /, unit="cm", *rest, exact=True, **more) -> int:
        import late
        return self.store.get(unit)

    async def wait(self): ...


def make(a, b=%12$d, *, c=None):
    unused_%4$s = branchy(a)
    kept = [x() for x in b]
    if a and b and c: kept = eval("%1$d")
    return kept
    "literal"
    late = 1
    raise ValueError


def branchy(x%13$s):
"""
TAIL = """    return x


def pick_v2(a%2$s):
    u = a.%1$s
    v = u
    return v

"""
#: Statements at the end of a file whose p_size is a multiple.
MORE = {2: 'if __name__ == "__main__":\n    make(1)\n', 3: 'token = "a"\n', 5: "subprocess.run(cmd, shell=True)\n", 7: "pickle.load(f)\n", 9: "yaml.load(f)\n", 10: "yaml.load(f, Loader=Safe)\n", 11: 'cursor.execute("q %s" % k)\n', 13: 'open("../x")\n'}


def dealt(spark, sf_dir) -> DataFrame:
    """part, dealt to as many tasks as are set: its rows are few bytes, and the texts made of them many."""
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def sources(spark, sf_dir) -> DataFrame:
    """path, size, content, as a tree is read."""
    part = dealt(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").alias("s"), "p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    k, s = F.col("k"), F.col("s")
    half, third = F.floor(k / 2), F.floor(k / 3)
    near = F.when(F.floor(k / 7) % 2 == 0, k + 7).otherwise(k - 7)
    cls = lambda n: F.concat(F.initcap("a"), (n % 40).cast("string"))
    head = F.format_string(HEAD, k, "p_name", "a", "b", half % 7, half, near, third % 7, third, cls(k), cls(k + 1), s, F.when(s % 2 == 0, ": int").otherwise(""))
    tail = F.format_string(TAIL, "b", F.when(s % 4 == 0, ": int").otherwise(""))
    own = F.when(k % 11 == 0, F.format_string("import b%d.p%d\n", k % 7, k)).otherwise("")
    more = [F.when(s % n == 0, text).otherwise("") for n, text in MORE.items()]
    text = F.concat(head, F.repeat(F.lit("    if x: pass\n"), s), tail, own, *more, F.when(k % 10 == 3, "def (\n").otherwise(""))
    mark, odd = F.when(k % 8 == 1, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.when(k % 8 == 2, F.unhex(F.lit("2320FF0A"))).otherwise(F.unhex(F.lit("")))
    python = part.select(F.when(k % 50 == 0, F.format_string("p%d.py", k)).otherwise(F.format_string("b%d/p%d.py", k % 7, k)).alias("path"), F.concat(mark, text.cast("binary"), odd).alias("content"))
    other = part.filter("k % 20 < 2").select(F.when(k % 20 == 0, F.format_string("b1/n%d.md", k)).otherwise(F.format_string("Makefile%d", k)).alias("path"), F.col("p_name").cast("binary").alias("content"))
    return python.unionByName(other).select("path", F.octet_length("content").cast("long").alias("size"), "content")


def project(spark, sf_dir) -> Project:
    """The tree of a folder's tables, read and parsed for each query."""
    return Project(spark, sources(spark, sf_dir))


PATH = "CASE WHEN {k} % 50 = 0 THEN 'p' || {k} || '.py' ELSE 'b' || {k} % 7 || '/p' || {k} || '.py' END"
P = f"""p AS (SELECT p_partkey AS k, p_size AS s, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, {PATH.format(k='p_partkey')} AS path, p_partkey % 10 = 3 AS bad,
  upper(a[1]) || a[2:] AS word, word || p_partkey % 40 AS cls, word || (p_partkey + 1) % 40 AS base, CASE WHEN p_partkey // 7 % 2 = 0 THEN p_partkey + 7 ELSE p_partkey - 7 END AS near,
  replace(replace(path, '.py', ''), '/', '.') AS module FROM part)"""
#: The file that a full name leads to: its folder's, if it lies in the root.
LEADS = "CASE WHEN {k} % 50 = 0 THEN 'b' || {k} % 7 || '/__init__.py' ELSE 'b' || {k} % 7 || '/p' || {k} || '.py' END"
EDGES = f"""{P}, e AS (
  SELECT path AS src, {LEADS.format(k='(k // 2)')} AS dst, 'abs' AS kind FROM p WHERE NOT bad
  UNION ALL SELECT path, {LEADS.format(k='k')}, 'abs' FROM p WHERE NOT bad AND k % 11 = 0 AND k % 50 = 0 AND k > 0
  UNION ALL SELECT path, {LEADS.format(k='(k // 3)')}, 'rel' FROM p WHERE NOT bad
  UNION ALL SELECT path, CASE WHEN near % 50 <> 0 AND near < (SELECT count(*) FROM part) THEN 'b' || k % 7 || '/p' || near || '.py' ELSE 'b' || k % 7 || '/__init__.py' END, 'rel' FROM p WHERE NOT bad AND k % 50 <> 0
  UNION ALL SELECT path, 'b' || k % 7 || '/__init__.py', 'rel' FROM p WHERE NOT bad AND k % 50 <> 0)"""


# ---- extraction


@query(rf"""WITH {P}, i AS (SELECT *, [a || '.' || b, 'b' || k // 2 % 7 || '.p' || k // 2, 'fast_' || b, 'os', 'slow'] || CASE WHEN k % 11 = 0 THEN ['b' || k % 7 || '.p' || k] ELSE [] END AS loaded FROM p)
SELECT path, CASE WHEN NOT bad THEN 'Part ' || k || ': ' || p_name || '.' END AS doc, bad AS parse_error, NOT bad AND s % 2 = 0 AS is_entry,
  CASE WHEN NOT bad THEN list_sort(list_distinct(loaded || ['late', 'never_loaded', 'typing_only'])) END AS imports, CASE WHEN NOT bad THEN list_sort(list_distinct(loaded)) END AS module_imports,
  CASE WHEN NOT bad THEN ['1:p' || near, '2:b' || k // 3 % 7 || '.p' || k // 3, '1:'] END AS relative FROM i""")
def source_modules(spark, sf_dir):
    """S4, S6, P3, P6, P7, P8"""
    p = project(spark, sf_dir)
    said = F.transform("relative_imports", lambda r: F.concat_ws(":", r["level"], r["module"]))
    return p.having("doc", "is_entry", "imports", "module_imports", "relative_imports").select("path", "doc", "parse_error", "is_entry", "imports", "module_imports", said.alias("relative"))


@query(rf"""WITH {P} SELECT path, t.kind, t.cls, t.name, t.lineno::INTEGER AS lineno, t.end_lineno::INTEGER AS end_lineno, t.sig FROM p, LATERAL (VALUES
  ('class', NULL, p.cls, 20, 27, NULL), ('method', p.cls, p.cls || '.size', 23, 25, '(self, unit=''cm'', *rest, exact=True, **more) -> int'), ('method', p.cls, p.cls || '.wait', 27, 27, '(self)'),
  ('function', NULL, 'make', 30, 37, '(a, b=' || p.s || ', *, c=None)'), ('function', NULL, 'branchy', 40, 41 + p.s, '(x)'), ('function', NULL, 'pick_v2', 44 + p.s, 47 + p.s, '(a)')) t(kind, cls, name, lineno, end_lineno, sig) WHERE NOT bad""")
def source_symbols(spark, sf_dir):
    """S6, P4, P9, P10, U1"""
    return project(spark, sf_dir).symbols()


@query(rf"""WITH {P} SELECT path, cls AS name, ['base.' || base, 'Generic[int]'] AS bases, ['property', 'cached(''' || k || ''')'] AS decorators, true AS is_async FROM p WHERE NOT bad""")
def source_classes(spark, sf_dir):
    """P5, P9"""
    c = project(spark, sf_dir).having("classes").select("path", F.explode("classes").alias("c"))
    return c.select("path", "c.name", "c.bases", F.col("c.methods")[0]["decorators"].alias("decorators"), F.col("c.methods")[1]["is_async"].alias("is_async"))


@query(rf"""WITH {P}, n AS (SELECT path AS x, module, unnest([module || '.make', module || '.branchy', module || '.pick_v2', module || '.' || cls || '.size', module || '.' || cls || '.wait']) AS name, cls FROM p WHERE NOT bad),
f AS (SELECT arg_min(module || '.branchy', path) AS first FROM p WHERE NOT bad),
c AS (SELECT name, x AS path, CASE WHEN ends_with(name, '.make') THEN list_sort(['eval', 'x', first]) WHEN ends_with(name, '.size') THEN ['cached', 'self.store.get'] ELSE [] END AS callees FROM n, f)
SELECT name, path, callees, CASE WHEN name = (SELECT first FROM f) THEN (SELECT list_sort(list(name)) FROM n WHERE ends_with(name, '.make')) ELSE [] END AS callers, false AS self_recursive FROM c""")
def source_callgraph(spark, sf_dir):
    """G3, G4, P12, J10, J11, U6"""
    return project(spark, sf_dir).callgraph()


@query(rf"WITH {P} SELECT 5 * count(*) AS total_functions, 5 * count(*) AS total_call_edges, count(*) AS total_caller_edges, 1.0::DOUBLE AS avg_callees_per_func FROM p WHERE NOT bad")
def source_call_stats(spark, sf_dir):
    """A13, X14"""
    return project(spark, sf_dir).call_stats()


RISKS = (("hardcoded_secret", 3), ("shell_injection", 5), ("pickle_load", 7), ("yaml_unsafe_load", 9), ("sql_injection", 11), ("path_traversal", 13))


def _risk_sql() -> str:
    grave = lambda n: n in findings.CRITICAL
    return " UNION ALL ".join(f"SELECT path, 'security_{n}', '{'yuksek' if grave(n) else 'orta'}', {grave(n)}, 'Güvenlik riski: {n} tespit edildi', '{n} kullanımını gözden geçirin, güvenli alternatif kullanın.', NULL FROM f WHERE s % {m} = 0" for n, m in RISKS)


@query(rf"""WITH {P}, f AS (SELECT * FROM p WHERE NOT bad),
h AS (SELECT path, s, unnest(['make', 'branchy', 'pick_v2', 'wait']) AS name FROM f WHERE s % 4 <> 0),
i(path, type, severity, kritik, detail, cozum, line) AS (
  SELECT path, 'unreachable_code', 'orta', false, '''return kept'' sonrası erişilemez kod var', 'Erişilemez kodu silin veya kontrol akışını düzeltin.', unnest([36, 37]) FROM f
  UNION ALL SELECT path, 'unused_variable', 'dusuk', false, 'Atanan ama kullanılmayan değişken: ''unused_' || b || ''' (satır 31)', 'Kullanılmayan değişkeni silin veya kullanın.', 31 FROM f
  UNION ALL SELECT path, 'unused_variable', 'dusuk', false, 'Atanan ama kullanılmayan değişken: ''late'' (satır 36)', 'Kullanılmayan değişkeni silin veya kullanın.', 36 FROM f
  UNION ALL SELECT path, 'security_eval_exec', 'yuksek', true, 'Güvenlik riski: eval_exec tespit edildi (''eval()'' çağrısı)', 'eval/exec yerine güvenli alternatif kullanın (örn. ast.literal_eval, açık dağıtım). Satır 33.', 33 FROM f
  UNION ALL SELECT path, 'yuksek_ciklik', CASE WHEN s + 1 < 30 THEN 'orta' ELSE 'yuksek' END, s + 1 > 30, 'Fonksiyon ''branchy'' cok karmaşık (CC=' || (s + 1) || ')', 'Fonksiyonu daha küçük parçalara bölün.', 40 FROM f WHERE s + 1 > 20
  UNION ALL SELECT path, 'missing_type_hint', 'dusuk', false, 'Fonksiyon ''' || name || ''' tür ipucu eksik', 'Fonksiyon imzasına tip ipuçları ekleyin.', NULL FROM h WHERE NOT (name = 'branchy' AND s % 2 = 0)
  UNION ALL {_risk_sql()})
SELECT path, type, severity, kritik, detail, cozum, line::INTEGER AS line FROM i""")
def source_findings(spark, sf_dir):
    """Q11-Q16, W8, X8, A18, A19, U7"""
    return findings.found(project(spark, sf_dir).files)


@query(rf"""WITH {P}, c AS (SELECT path, CASE WHEN bad THEN 0 ELSE 5 END AS functions, CASE WHEN bad THEN 0 ELSE 1 + (s % 2 = 0)::INTEGER + (s % 4 = 0)::INTEGER END AS hinted FROM p)
SELECT path, functions, hinted, CASE WHEN functions > 0 THEN round(100.0::DOUBLE * hinted / functions, 1) ELSE 100.0::DOUBLE END AS coverage FROM c""")
def source_hints(spark, sf_dir):
    """A18"""
    return project(spark, sf_dir).hint_coverage()


@query(rf"WITH {P} SELECT path, unnest(['make', 'branchy', 'pick_v2', 'size', 'wait']) AS name, unnest([4, 1 + s, 1, 1, 1])::INTEGER AS complexity, unnest([2, 1, 1, 1, 1])::INTEGER AS argc FROM p WHERE NOT bad")
def source_complexity(spark, sf_dir):
    """A19; the self of size stands before the slash and does not count"""
    return project(spark, sf_dir).functions_ast("branches").select("path", "name", "complexity", "argc")


TWINS = f"""{P}, f AS (SELECT * FROM p WHERE NOT bad),
m AS (
  SELECT 'hash' AS method, 'Expr' AS x, 'make' AS name, path, 30 AS line FROM f
  UNION ALL SELECT 'hash', s || '', 'branchy', path, 40 FROM f WHERE s >= 2
  UNION ALL SELECT 'hash', b || (s % 4 = 0), 'pick_v2', path, 44 + s FROM f
  UNION ALL SELECT 'kinds', '', 'pick_v2', path, 44 + s FROM f),
g AS (SELECT method, name, x, arg_min(path || ':' || line || ':' || name, (path, line)) AS first, count(*) AS n FROM m GROUP BY method, name, x HAVING count(*) > 1)"""


@query(f"""WITH {TWINS} SELECT g.method, g.first AS group_first, m.path || ':' || m.line || ':' || m.name AS member, CASE WHEN m.name = 'pick_v2' THEN 'pick' ELSE m.name END AS fuzzy_base, n, 1::BIGINT AS n_bases, 100.0::DOUBLE AS similarity_avg, 100.0::DOUBLE AS similarity_min,
  '[' || n || ' kopya, benzerlik ~100.0%]' AS advice, CASE WHEN g.method = 'kinds' THEN printf('TG-%03d', 1 + (SELECT count(*) FROM g WHERE method = 'hash')) END AS kinds_id FROM m JOIN g ON m.method = g.method AND m.name = g.name AND m.x = g.x""")
def source_twins(spark, sf_dir):
    """All members of each group, a row each, with what is known of the group; a group of kinds with the members of a group of hashes is left out"""
    p = project(spark, sf_dir)
    named = lambda m: F.concat_ws(":", m["path"], m["line"], m["name"])
    found = p.twins().select("group_id", "method", named(F.col("first")[0]).alias("group_first"), "n", "n_bases", "similarity_avg", "similarity_min", F.regexp_extract("remediation", r"^\[[^\]]*\]", 0).alias("advice"), F.when(F.col("method") == "kinds", F.col("group_id")).alias("kinds_id"))
    members = p.twin_members().select("group_id", F.concat_ws(":", "path", "line", "name").alias("member"), "fuzzy_base")
    return members.join(found, "group_id").drop("group_id")


@query(f"""WITH {TWINS} SELECT g.method, g.first AS group_first, m.path, m.line::INTEGER AS line, m.name, CASE WHEN m.name = 'pick_v2' THEN 'pick' ELSE m.name END AS fuzzy_base FROM m JOIN g ON m.method = g.method AND m.name = g.name AND m.x = g.x""")
def source_twin_members(spark, sf_dir):
    """A row for each member of each group, with the first member of its group"""
    p = project(spark, sf_dir)
    first = F.col("first")[0]
    label = p.twins().select("group_id", F.concat_ws(":", first["path"], first["line"], first["name"]).alias("group_first"))
    return p.twin_members().join(label, "group_id").select("method", "group_first", "path", "line", "name", "fuzzy_base")


@query(rf"""WITH {P} SELECT count(*) AS total_py, count(*) FILTER (k % 20 < 2) AS total_non_py, total_py + total_non_py AS total_files, count(*) FILTER (NOT bad) AS total_classes, 3 * count(*) FILTER (NOT bad) AS total_functions,
  list_sort(list(DISTINCT 'b' || k % 7) FILTER (k % 50 <> 0)) AS subsystems, list_sort(list(path) FILTER (NOT bad AND s % 2 = 0)) AS entry_files FROM p""")
def source_stats(spark, sf_dir):
    """S5, S7, A1, A2"""
    return project(spark, sf_dir).stats().select("total_py", "total_non_py", "total_files", "total_classes", "total_functions", "subsystems", "entry_files")


@query(r"SELECT CASE WHEN p_partkey % 20 = 0 THEN 'b1/n' || p_partkey || '.md' ELSE 'Makefile' || p_partkey END AS path, strlen(p_name)::BIGINT AS size, CASE WHEN p_partkey % 20 = 0 THEN '.md' ELSE '(none)' END AS ext, sha256(p_name) AS sha256 FROM part WHERE p_partkey % 20 < 2")
def source_other_files(spark, sf_dir):
    """S5, P13, X1"""
    return project(spark, sf_dir).other_files.select("path", "size", "ext", "sha256")


SHAPE = """from b%1$d.p%2$d import *


async def fetch(url, *, retry=lambda n: n + %3$d):
    async with session(url) as s:
        async for x in s:
            yield x


def outer(a, b=(1, %3$d)):
    def inner(c):
        return a + c
    match a:
        case [x, *_] if x:
            return inner(x)
        case {"k": v}:
            return v
        case _:
            return (lambda q: q)(b)


class %4$s(outer(1).base, metaclass=Meta):
    value: int = %3$d

    class Deep:
        def run(self): ...


"""
#: What the parser of the standard library reads, and its own walks by recursion don't.
DEEP_SUM, DEEP_CHAIN = "total = 0" + " + 1" * 1500 + "\n", "if a: pass\n" + "".join(f"elif a == {k}: import m{k}\n" for k in range(1200))


def shapes(spark, sf_dir) -> DataFrame:
    """Sources of other shapes; of fifty, one has a sum of 1,500 terms and one a chain of 1,200 conditions."""
    part = dealt(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").alias("s"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("cls"))
    k = F.col("k")
    text = F.concat(F.format_string(SHAPE, k % 7, k, "s", "cls"), F.when(k % 50 == 7, DEEP_SUM).when(k % 50 == 8, DEEP_CHAIN).otherwise(""))
    return part.select(F.format_string("s/p%d.py", k).alias("path"), text.cast("binary").alias("content")).select("path", F.octet_length("content").cast("long").alias("size"), "content")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, split_part(p_name, ' ', 1) AS a FROM part)
SELECT 's/p' || k || '.py' AS path, false AS parse_error, NULL AS error, CASE WHEN k % 50 = 8 THEN 1201 ELSE 1 END AS n_imports, CASE WHEN k % 50 = 8 THEN 1201 ELSE 1 END AS n_loaded, {SHAPE.count(chr(10)) + 1} + CASE k % 50 WHEN 7 THEN {DEEP_SUM.count(chr(10))} WHEN 8 THEN {DEEP_CHAIN.count(chr(10))} ELSE 0 END AS lines,
  ['fetch(url, *, retry=lambda n: n + ' || s || ')', 'outer(a, b=(1, ' || s || '))'] AS functions, [upper(a[1]) || a[2:] || ': outer(1).base'] AS classes, ['fetch > session', 'inner > ', 'outer > inner', 'run > '] AS calls FROM p""")
def source_shapes(spark, sf_dir):
    """Pattern matching, nested functions and classes, star imports, asynchronous blocks, lambdas as defaults; sources that nest deeply give facts as well"""
    files = Project(spark, shapes(spark, sf_dir)).having("imports", "module_imports", "classes", "functions", "callees")
    said = F.transform("functions", lambda f: F.concat(f["name"], f["sig"]))
    based = F.transform("classes", lambda c: F.concat(c["name"], F.lit(": "), F.array_join(c["bases"], ",")))
    calls = F.array_sort(F.transform("bodies", lambda b: F.concat(b["name"], F.lit(" > "), F.array_join(b["callees"], ","))))
    return files.select("path", "parse_error", "error", F.size("imports").alias("n_imports"), F.size("module_imports").alias("n_loaded"), "lines", said.alias("functions"), based.alias("classes"), calls.alias("calls"))


# ---- imports


@query(f"WITH {EDGES} SELECT src, dst, kind, count(*) AS n FROM e WHERE src <> dst GROUP BY src, dst, kind")
def source_import_edges(spark, sf_dir):
    """J3, J4, F2, T2, T3"""
    return project(spark, sf_dir).import_edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND NOT ends_with(dst, '__init__.py')), r AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON r.dst = d.src), m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src) SELECT list_sort(list(node)) AS members FROM m GROUP BY component")
def source_cycles(spark, sf_dir):
    """F3, G1, O6"""
    return project(spark, sf_dir).import_cycles()


@query(f"WITH {EDGES} SELECT split_part(src, '/', 1) AS src_area, split_part(dst, '/', 1) AS dst_area, count(*) AS n FROM e WHERE contains(src, '/') AND split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY 1, 2")
def source_matrix(spark, sf_dir):
    """Between folders, repeated edges counted"""
    return project(spark, sf_dir).dependency_matrix()


@query(f"""WITH {EDGES}, x AS (SELECT DISTINCT split_part(src, '/', 1) AS s, split_part(dst, '/', 1) AS d FROM e WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)),
t AS (SELECT area, (SELECT count(*) FROM x WHERE s = area) AS imports_others, (SELECT count(*) FROM x WHERE d = area) AS imported_by FROM (SELECT DISTINCT split_part(path, '/', 1) AS area FROM p WHERE k % 50 <> 0)),
l AS (SELECT *, (row_number() OVER (ORDER BY imported_by DESC, imports_others, area) - 1)::INTEGER AS level FROM t)
SELECT area, imports_others, imported_by, level, CASE WHEN level = max(level) OVER () THEN 'UI/giris katmani' WHEN imports_others <= 1 THEN 'Kutuphane/ortak modul' WHEN imported_by = 0 THEN 'Ust-yapi/konfigurasyon' ELSE 'Servis/is mantigi' END AS role FROM l""")
def source_layers(spark, sf_dir):
    """P15, A15, W1, W6, G7"""
    return project(spark, sf_dir).layers()


@query(f"""WITH {P}, c AS (SELECT path, cls, base FROM p WHERE NOT bad) SELECT a.path AS sub_path, a.cls AS sub, 20 AS sub_line, a.base, b.path AS base_path, 20 AS base_line FROM c a JOIN c b ON a.base = b.cls""")
def source_subclasses(spark, sf_dir):
    """A class with every class of its base's name, wherever that lies"""
    return insights.subclass_pairs(project(spark, sf_dir).classes()).select("sub_path", "sub", "sub_line", "base", "base_path", "base_line")


BASES = f"""{P}, c AS (SELECT path, cls, base FROM p WHERE NOT bad), n AS (SELECT base, count(*) AS n FROM c GROUP BY base),
k AS (SELECT c.path AS base_path, c.cls AS base, 20 AS base_line, n FROM c JOIN n ON c.cls = n.base ORDER BY n DESC, c.cls, c.path LIMIT 50)"""


@query(f"""WITH {BASES}, f AS (SELECT base, list(cls ORDER BY rn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS rn FROM c) WHERE rn <= 5 GROUP BY base)
SELECT base_path, k.base, base_line, n, first FROM k JOIN f ON k.base = f.base WHERE n >= 2""")
def source_base_classes(spark, sf_dir):
    """By file, name and line; many files have a class of one name"""
    return project(spark, sf_dir).base_classes().withColumn("first", F.transform("first", lambda m: m["sub"]))


@query(f"WITH {BASES} SELECT base_path, k.base, base_line, c.path AS sub_path, c.cls AS sub, 20 AS sub_line FROM k JOIN c ON c.base = k.base WHERE n >= 2")
def source_extensions(spark, sf_dir):
    """The subclasses of these, with their places"""
    return project(spark, sf_dir).extensions()


DECLARED = ["os-extra", "slow.down", "ring-kit>=2", "requests", "Pillow>=9", "pyyaml", "unheard_of"]
SOME = ["PIL", "yaml", "json", "__future__", "b1", "cv2", "Requests.Toolbelt"]


@query(f"""WITH {P}, d AS (SELECT unnest({DECLARED}) AS declared), i AS (SELECT DISTINCT unnest([a, 'os', 'slow', 'late', 'fast_' || b]) AS imported FROM p WHERE NOT bad UNION SELECT unnest({SOME})),
n AS (SELECT declared, lower(replace(replace(declared, '-', '_'), '.', '_')) AS norm, CASE lower(regexp_extract(declared, '^([A-Za-z0-9_.-]+)', 1)) WHEN 'pillow' THEN 'pil' WHEN 'pyyaml' THEN 'yaml' END AS alias FROM d),
m AS (SELECT lower(replace(replace(imported, '-', '_'), '.', '_')) AS imp FROM i)
SELECT declared FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE contains(norm, imp) OR contains(imp, norm) OR alias = imp)""")
def source_unused(spark, sf_dir):
    """No import contains the name, or lies in it, or has it as its package"""
    from ..operators import usage

    return usage.unused(*_usage(spark, sf_dir))


def _usage(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = project(spark, sf_dir)
    return spark.createDataFrame([(d,) for d in DECLARED], "declared string"), p._imports().filter("imported not rlike '^b[0-9]$'  and imported not in ('never_loaded', 'typing_only')").union(spark.createDataFrame([(x,) for x in SOME], "imported string"))


@query(f"""WITH {P}, d AS (SELECT lower(replace(replace(unnest({DECLARED}), '-', '_'), '.', '_')) AS norm), i AS (SELECT DISTINCT unnest([a, 'os', 'slow', 'late', 'fast_' || b]) AS imported FROM p WHERE NOT bad UNION SELECT unnest({SOME})),
m AS (SELECT imported, lower(replace(replace(imported, '-', '_'), '.', '_')) AS imp, CASE imported WHEN 'PIL' THEN 'pillow' WHEN 'yaml' THEN 'pyyaml' WHEN 'cv2' THEN 'opencv_python' END AS alias FROM i WHERE imported NOT IN ('os', 'json', '__future__', 'b1'))
SELECT imported FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(norm, imp) OR contains(imp, norm) OR contains(norm, alias) OR contains(alias, norm))""")
def source_undeclared(spark, sf_dir):
    """Neither the standard library's, nor the tree's, nor declared under the name or the package's"""
    from ..operators import usage

    internal = spark.createDataFrame([(f"b{n}",) for n in range(7)], "name string")
    return usage.undeclared(*_usage(spark, sf_dir), internal)


# ---- lookups and changes


DIFF = "SELECT 3 * k AS n, '+++ b/' || path AS value FROM p UNION ALL SELECT 3 * k + 1, '@@ -1 +' || (20 + s) || ',' || s % 3 || ' @@' FROM p UNION ALL SELECT 3 * k + 2, '@@ -9,2 +25 @@ def' FROM p"


def _diff(spark, sf_dir) -> DataFrame:
    """Two hunks a file: p_size % 3 lines from 20 + p_size on, and line 25."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    path = F.when(F.col("k") % 50 == 0, F.format_string("p%d.py", "k")).otherwise(F.format_string("b%d/p%d.py", F.col("k") % 7, F.col("k")))
    lines = F.array(F.concat(F.lit("+++ b/"), path), F.format_string("@@ -1 +%d,%d @@", F.col("s") + 20, F.col("s") % 3), F.lit("@@ -9,2 +25 @@ def"))
    return part.select("k", F.posexplode(lines).alias("i", "value")).select((3 * F.col("k") + F.col("i")).cast("long").alias("n"), "value")


@query(f"WITH {P} SELECT path, unnest(range(20 + s, 20 + s + s % 3))::INTEGER AS line FROM p UNION ALL SELECT path, 25 FROM p")
def git_lines(spark, sf_dir):
    """A hunk of no lines gives none, one without a number has one"""
    return git.changed_lines(_diff(spark, sf_dir))


@query(f"""WITH {P}, c AS (SELECT path, cls, s, unnest(range(20 + s, 20 + s + s % 3) || [25]) AS line FROM p WHERE NOT bad),
n AS (SELECT path, line, CASE WHEN line BETWEEN 23 AND 25 THEN cls || '.size' WHEN line = 27 THEN cls || '.wait' WHEN line BETWEEN 20 AND 27 THEN cls WHEN line BETWEEN 30 AND 37 THEN 'make' WHEN line BETWEEN 40 AND 41 + s THEN 'branchy' WHEN line BETWEEN 44 + s AND 47 + s THEN 'pick_v2' END AS symbol FROM c)
SELECT path, symbol, min(line)::INTEGER AS line FROM n WHERE symbol IS NOT NULL GROUP BY path, symbol""")
def source_changed_symbols(spark, sf_dir):
    """J5, F12, A22, L4"""
    return project(spark, sf_dir).changed_symbols(git.changed_lines(_diff(spark, sf_dir)))


@query("""SELECT 'd/p' || p_partkey || CASE WHEN p_size % 3 = 0 THEN ' x.py' ELSE '.pyw' END AS path, ['modified', 'new', 'deleted', 'modified', 'new'][p_partkey % 5 + 1] AS state FROM part WHERE p_partkey % 4 <> 3""")
def git_states(spark, sf_dir):
    """Names in quotes, renames, and files of other kinds"""
    k = F.col("p_partkey")
    name = F.concat(F.lit("d/p"), k, F.when(F.col("p_size") % 3 == 0, " x.py").otherwise(".pyw"), F.when(k % 4 == 3, ".txt").otherwise(""))
    code = F.element_at(F.array(*map(F.lit, (" M ", "?? ", "D  ", "R  ", "A  "))), (k % 5 + 1).cast("int"))
    quote = F.when(F.contains(name, F.lit(" ")), '"').otherwise("")
    return git.status(table(spark, sf_dir, "part").select(F.concat(code, F.when(k % 5 == 3, "old.py -> ").otherwise(""), quote, name, quote).alias("value")))


@query(f"WITH {P} SELECT path, 'method' AS kind, cls || '.wait' AS name, 27 AS lineno FROM p WHERE NOT bad")
def source_find(spark, sf_dir):
    """A method by its bare name, in any case"""
    return project(spark, sf_dir).find("WAIT").select("path", "kind", "name", "lineno")


@query(f"""WITH {P}, s AS (SELECT * FROM p WHERE path = 'b2/p9.py' AND NOT bad) SELECT t.name, t.lineno::INTEGER AS lineno FROM s, LATERAL (VALUES (s.cls, 20), (s.cls || '.size', 23), (s.cls || '.wait', 27), ('make', 30), ('branchy', 40), ('pick_v2', 44 + s.s)) t(name, lineno)""")
def source_outline(spark, sf_dir):
    """L2, J6"""
    return project(spark, sf_dir).outline("p9.py").select("name", "lineno")


@query(f"WITH {EDGES} SELECT DISTINCT 'dependent' AS role, src AS path FROM e WHERE dst = 'b2/p9.py' UNION SELECT 'dependency', dst FROM e WHERE src = 'b2/p9.py' AND dst <> src")
def source_impact(spark, sf_dir):
    """By a partial path"""
    return project(spark, sf_dir).impact("p9.py")


@query(f"""WITH {P}, m AS (SELECT 'pick' AS g, path, k >= 100 AS is_new FROM p WHERE NOT bad), b AS (SELECT b || (s % 4 = 0) AS g, k >= 100 AS is_new FROM p WHERE NOT bad), s AS (SELECT s || '' AS g, k >= 100 AS is_new FROM p WHERE NOT bad AND s >= 2),
r AS (SELECT 'make' AS what, is_new, g FROM m UNION ALL SELECT 'kinds', is_new, g FROM m UNION ALL SELECT 'pick', is_new, g FROM b UNION ALL SELECT 'branchy', is_new, g FROM s)
SELECT count(*) FILTER (is_new) AS n_new, count(*) FILTER (NOT is_new) AS n_old FROM r GROUP BY what, g HAVING count(*) FILTER (is_new) > 0 AND count(*) FILTER (NOT is_new) > 0""")
def source_gate(spark, sf_dir):
    """Files of number 100 and more are new"""
    p = project(spark, sf_dir)
    added = p.sources.filter(F.regexp_extract("path", r"p(\d+)\.py$", 1).cast("int") >= 100).select("path", F.lit("added").alias("status"))
    return p.new_twins(added).select("n_new", "n_old")


@query("""WITH n AS (SELECT DISTINCT p_brand, p_name, list_distinct(string_split(p_name, '')) AS ws FROM part), s AS (SELECT a.p_brand, a.p_name AS a, b.p_name AS b, round(100.0::DOUBLE * len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 1) AS similarity FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)
SELECT p_brand, a, b, CASE WHEN similarity >= 95 THEN 'Birebir' WHEN similarity >= 75 THEN 'Ortak' ELSE 'Yapisal' END AS advice FROM s""")
def twin_advice(spark, sf_dir):
    """All three branches"""
    pairs = queries.pairwise_jaccard(spark, sf_dir)
    members = F.array(F.struct(F.col("a").alias("path"), F.lit(1).alias("line")))
    said = twins.remediation(F.col("similarity"), F.lit(2), members)
    return pairs.select("p_brand", "a", "b", F.regexp_extract(said, r"\] (\w+)", 1).alias("advice"))
