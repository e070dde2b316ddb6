"""The operators on the driver's tables, each with the SQL that gives the same rows.

The tables hold no source trees, so documents stand for files: a document lies at
source/lang/doc_id, and those of English at source-doc_id, in the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import graph, joins, quality, snapshots, twins

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("lang") == "en", F.concat_ws("-", "source", "doc_id")).otherwise(F.concat_ws("/", "source", "lang", "doc_id"))
    return docs.select("doc_id", path.alias("path"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


FILES = "f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN source || '-' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS path, source, lang, coalesce(text, '') AS text FROM documents)"
LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"
SUB = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END"


# ---- scans, projections, aggregates


@query(f"WITH {FILES} SELECT count(*) AS total_files, sum({LINES})::BIGINT AS total_lines, sum(length(text))::BIGINT AS total_chars, list_sort(list(DISTINCT {SUB})) AS subsystems FROM f")
def corpus_stats(spark, sf_dir):
    """A1, A2, P1, P2"""
    return files(spark, sf_dir).agg(F.count("*").alias("total_files"), F.sum(paths.line_count("text")).cast("long").alias("total_lines"), F.sum(F.char_length("text")).cast("long").alias("total_chars"), F.array_sort(F.collect_set(paths.subsystem("path"))).alias("subsystems"))


@query(f"""WITH {FILES}, s AS (SELECT {SUB} AS subsystem, count(*) AS files, sum({LINES})::BIGINT AS lines, round(avg(length(text)), 1) AS avg_chars, max({LINES})::BIGINT AS longest FROM f GROUP BY 1)
SELECT coalesce(s.subsystem, r.x) AS subsystem, coalesce(files, 0) AS files, coalesce(lines, 0)::BIGINT AS lines, avg_chars, longest FROM s FULL JOIN (SELECT '_root' AS x) r ON s.subsystem = r.x""")
def subsystem_rollup(spark, sf_dir):
    """_root is there even if nothing lies in it."""
    rows = files(spark, sf_dir).withColumn("subsystem", paths.subsystem("path")).groupBy("subsystem").agg(F.count("*").alias("files"), F.sum(paths.line_count("text")).cast("long").alias("lines"), F.round(F.avg(F.char_length("text")), 1).alias("avg_chars"), F.max(paths.line_count("text")).cast("long").alias("longest"))
    root = spark.createDataFrame([("_root",)], "subsystem string")
    return rows.join(root, "subsystem", "full_outer").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("lines", F.coalesce("lines", F.lit(0)))


@query(f"WITH {FILES} SELECT path, sha256(text) AS sha256, md5(text)[1:12] AS short_hash, strlen(text)::BIGINT AS size FROM f")
def fingerprint(spark, sf_dir):
    """X1"""
    return files(spark, sf_dir).select("path", F.sha2("text", 256).alias("sha256"), names.short_hash("text").alias("short_hash"), F.octet_length("text").cast("long").alias("size"))


@query(f"""WITH {FILES} SELECT path, {SUB} AS subsystem, split_part(path, '/', 1) AS top, string_split(path, '/')[-1] AS base, (len(string_split(path, '/')) - 1)::BIGINT AS depth,
  coalesce(nullif(regexp_extract(replace(path, '-', '.'), '[^/.][^/]*(\\.[^./]+)$', 1), ''), '(none)') AS ext, replace(replace(path, '-', '.'), '/', '.') AS module,
  split_part(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), 1) AS doc FROM f""")
def path_parts(spark, sf_dir):
    """P1, P3, P11, P13, X12"""
    dotted = F.replace("path", F.lit("-"), F.lit("."))
    return files(spark, sf_dir).select("path", paths.subsystem("path").alias("subsystem"), paths.first_segment("path").alias("top"), paths.basename("path").alias("base"), paths.depth("path").cast("long").alias("depth"), paths.extension(dotted).alias("ext"), paths.module_path(dotted).alias("module"), paths.first_line("text").alias("doc"))


@query("""SELECT p_partkey, lower(replace(replace(p_brand || '.' || p_type, '-', '_'), '.', '_')) AS normal, regexp_extract(p_name || '>=1', '^([A-Za-z0-9_.\\-]+)', 1) AS base,
  replace(lower(trim(' ' || p_name)), ' ', '-') AS project, lower(regexp_replace(replace(p_name, ' ', '_') || CASE WHEN p_size < 10 THEN '_old' WHEN p_size < 20 THEN '_v2' WHEN p_size < 30 THEN 'V2' ELSE '' END, '(?i)(_v\\d+|_new|_old|_fix|_copy|_dup|V2|New)$', '')) AS fuzzy FROM part""")
def fuzzy_names(spark, sf_dir):
    """X3, X4, X5, X21"""
    suffix = F.when(F.col("p_size") < 10, "_old").when(F.col("p_size") < 20, "_v2").when(F.col("p_size") < 30, "V2").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", names.normal_name(F.concat_ws(".", "p_brand", "p_type")).alias("normal"), names.requirement_base(F.concat("p_name", F.lit(">=1"))).alias("base"), names.project_name(F.concat(F.lit(" "), "p_name")).alias("project"), names.fuzzy_base(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix)).alias("fuzzy"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, coalesce((props::JSON ->> '$.absent')::INTEGER, 7) AS with_default, '{"type":"' || event_type || '","k":' || (props::JSON ->> '$.k') || '}' AS encoded, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def json_props(spark, sf_dir):
    """X16, X18, X19"""
    parsed = F.from_json("props", "map<string,int>")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(F.try_element_at(parsed, F.lit("absent")), F.lit(7)).alias("with_default"), F.to_json(F.struct(F.col("event_type").alias("type"), parsed["k"].alias("k"))).alias("encoded"), names.iso_seconds("ts").alias("at"))


@query(f"WITH {FILES} SELECT path, i::BIGINT AS line, ls[i] AS content FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM f)))")
def line_explode(spark, sf_dir):
    """W5, T19"""
    return files(spark, sf_dir).select("path", F.posexplode(paths.lines("text")).alias("i", "content")).select("path", (F.col("i") + 1).cast("long").alias("line"), "content")


@query(f"""WITH {FILES}, l AS (SELECT path, i::BIGINT AS line, ls[i] AS content FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS ls FROM f)))
SELECT path, line, upper(regexp_extract(content, '(?i)(licensed|released|token|see)', 1)) AS tag, substr(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 200) AS content FROM l
WHERE contains(content, '.') AND regexp_matches(content, '(?i)(licensed|released|token|see)')""")
def tag_lines(spark, sf_dir):
    """F5, X6, X7, W5, with words that occur in the texts"""
    words = "licensed|released|token|see"
    rows = files(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("i", "content")).filter(F.contains("content", F.lit(".")) & F.col("content").rlike(f"(?i)({words})"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("line"), names.tag("content", words).alias("tag"), names.tag_text("content").alias("content"))


SECRET = r"""(password|secret|token|key)\s*=\s*["']"""


@query(f"""WITH {FILES}, m AS (SELECT path, unnest(regexp_extract_all(text, '{SECRET.replace("'", "''")}', 1)) AS word FROM f) SELECT path, word, count(*) AS n FROM m GROUP BY path, word""")
def secret_scan(spark, sf_dir):
    """One pattern, all matches"""
    hits = files(spark, sf_dir).filter(F.col("text").rlike(SECRET)).select("path", F.explode(F.regexp_extract_all("text", F.lit(SECRET), F.lit(1))).alias("word"))
    return hits.groupBy("path", "word").agg(F.count("*").alias("n"))


# ---- snapshots


def _snapshots(spark, sf_dir):
    """Before: all documents. After: German ones under de2, mail addresses blanked, toxic ones gone, benchmark items new."""
    now = files(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    moved = F.when(F.col("lang") == "de", F.concat(F.lit("de2/"), "path")).otherwise(F.col("path"))
    kept = now.join(toxic, "doc_id", "left_anti").select(moved.alias("path"), F.regexp_replace("text", r"[a-z0-9.]+@[a-z0-9.]+", "").alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id")).alias("path"), "text")
    hashed = lambda df: df.select("path", F.sha2("text", 256).alias("sha256"))
    return hashed(now), hashed(kept.unionByName(items))


SNAPSHOTS = rf"""{FILES},
old AS (SELECT path, sha256(text) AS sha256 FROM f),
new AS (
  SELECT CASE WHEN lang = 'de' THEN 'de2/' || path ELSE path END AS path, sha256(regexp_replace(text, '[a-z0-9.]+@[a-z0-9.]+', '', 'g')) AS sha256
  FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT 'bench/' || item_id, sha256(text) FROM benchmark),
c AS (SELECT coalesce(old.path, new.path) AS path, old.sha256 AS o, new.sha256 AS n FROM old FULL JOIN new ON old.path = new.path),
gone AS (SELECT path, o AS h, row_number() OVER (PARTITION BY o ORDER BY path) AS rn FROM c WHERE n IS NULL),
come AS (SELECT path, n AS h, row_number() OVER (PARTITION BY n ORDER BY path) AS rn FROM c WHERE o IS NULL),
m AS (SELECT gone.path AS old_path, come.path AS new_path, gone.h AS sha256 FROM gone JOIN come ON gone.h = come.h AND gone.rn = come.rn),
d AS (
  SELECT path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' WHEN o <> n THEN 'modified' ELSE 'unchanged' END AS status, NULL::VARCHAR AS old_path
  FROM c WHERE path NOT IN (SELECT old_path FROM m) AND path NOT IN (SELECT new_path FROM m)
  UNION ALL SELECT new_path, 'moved', old_path FROM m)"""


@query(f"WITH {SNAPSHOTS} SELECT path, status, old_path FROM d")
def snapshot_diff(spark, sf_dir):
    """J1, J2, U2, U3, U9, W2"""
    return snapshots.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS} SELECT old_path, new_path, sha256 FROM m")
def snapshot_moves(spark, sf_dir):
    """J2, W2"""
    return snapshots.moves(snapshots.classify(*_snapshots(spark, sf_dir)))


@query(f"WITH {SNAPSHOTS} SELECT status, count(*) AS n FROM d GROUP BY status")
def snapshot_counts(spark, sf_dir):
    """The counts of a diff"""
    return snapshots.diff(*_snapshots(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOTS}, kv AS (SELECT path, length(text)::BIGINT AS note FROM f) SELECT coalesce(new_path, kv.path) AS path, note FROM kv LEFT JOIN (SELECT * FROM m WHERE new_path NOT IN (SELECT path FROM kv)) v ON kv.path = v.old_path")
def rekey_on_move(spark, sf_dir):
    """J15"""
    kv = files(spark, sf_dir).select("path", F.char_length("text").cast("long").alias("note"))
    return snapshots.rekey(kv, snapshots.moves(snapshots.classify(*_snapshots(spark, sf_dir))))


@query(f"WITH {SNAPSHOTS} SELECT path, sha256 FROM new WHERE sha256 NOT IN (SELECT sha256 FROM old)")
def facts_cache_miss(spark, sf_dir):
    """I1"""
    old, new = _snapshots(spark, sf_dir)
    return snapshots.cache_misses(new, old.withColumn("version", F.lit("1")), "1")


@query(f"WITH {SNAPSHOTS} SELECT new.path AS path, old.path IS NULL AS new FROM new LEFT JOIN old ON new.path = old.path WHERE new.sha256 IS DISTINCT FROM old.sha256")
def changed_without_history(spark, sf_dir):
    """J13, U4"""
    old, new = _snapshots(spark, sf_dir)
    return snapshots.changed_since(new, old)


@query(f"WITH {SNAPSHOTS} SELECT DISTINCT split_part(path, '/', 1) AS area FROM new WHERE split_part(path, '/', 1) NOT IN (SELECT split_part(path, '/', 1) FROM old)")
def new_areas(spark, sf_dir):
    """I3"""
    old, new = (df.withColumn("area", paths.first_segment("path")) for df in _snapshots(spark, sf_dir))
    return snapshots.new_areas(old, new, "area")


# ---- quality


def facts(spark, sf_dir) -> DataFrame:
    """Counts of a text in the place of a source's: lines; words as imports over 40, capitals as classes, commas as methods, colons as functions."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    return files(spark, sf_dir).select(
        "path", paths.line_count("text").alias("lines"), F.floor(n("[^ \n]+") / 40).cast("int").alias("n_imports"), n("[A-Z]").alias("n_classes"), F.least(n("[A-Z]"), n(",")).alias("n_classes_with_methods"),
        n(",").alias("n_methods"), n(";").alias("n_decorated_methods"), n(";").alias("n_decorators"), n(r"\|").alias("n_functions"), F.contains("text", F.lit("***")).alias("parse_error"),
    )


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


FACTS = f"""{FILES}, facts AS (SELECT path, {LINES} AS lines, {_n('[^ ' + chr(10) + ']+')} // 40 AS n_imports, {_n('[A-Z]')} AS n_classes, least({_n('[A-Z]')}, {_n(',')}) AS n_classes_with_methods,
  {_n(',')} AS n_methods, {_n(';')} AS n_decorated_methods, {_n(';')} AS n_decorators, {_n('[|]')} AS n_functions, contains(text, '***') AS parse_error FROM f),
scores AS (SELECT *, round(aktiflik + gereklilik + kod_kalitesi + butunluk, 1) AS toplam FROM (SELECT path,
  round(least(least(1.5::DOUBLE * n_imports, 5) + least(2.0::DOUBLE * n_classes, 5), 10), 1) AS aktiflik,
  (CASE WHEN lines > 500 THEN 10 WHEN lines > 200 THEN 8 WHEN lines > 50 THEN 6 WHEN lines > 10 THEN 4 ELSE 2 END)::DOUBLE AS gereklilik,
  round(least(5 + n_classes_with_methods + 0.5::DOUBLE * n_decorated_methods, 10), 1) AS kod_kalitesi,
  (CASE WHEN n_classes > 0 THEN 4 ELSE 0 END + CASE WHEN n_methods > 0 THEN 3 ELSE 0 END + CASE WHEN n_functions > 0 THEN 2 ELSE 0 END + CASE WHEN n_imports > 0 THEN 1 ELSE 0 END)::DOUBLE AS butunluk FROM facts)),
issues AS (
  SELECT path, 'buyuk_dosya' AS type, CASE WHEN lines > 1500 THEN 'kritik' ELSE 'orta' END AS severity, lines > 1500 AS kritik, lines || ' satir - tek dosyada cok fazla sorumluluk (SRP ihlali)' AS detail FROM facts WHERE lines > 1000
  UNION ALL SELECT path, 'fazla_bagimlilik', 'dusuk', false, n_imports || ' import - fazla dis bagimlilik' FROM facts WHERE n_imports > 20
  UNION ALL SELECT path, 'sinif_eksik', 'dusuk', false, 'Sadece ' || n_functions || ' fonksiyon, 0 sinif - OOP icin sinif dusunulebilir' FROM facts WHERE n_classes = 0 AND n_functions > 5
  UNION ALL SELECT path, 'decorator_eksik', 'dusuk', false, n_methods || ' metod var ama 0 decorator' FROM facts WHERE n_methods > 5 AND n_decorators = 0
  UNION ALL SELECT path, 'parse_hatasi', 'kritik', true, 'Dosya AST ile parse edilemiyor (SyntaxError)' FROM facts WHERE parse_error)"""
PRIORITY = "(CASE WHEN kritik THEN 1000 ELSE 0 END + 20 * CASE severity WHEN 'dusuk' THEN 1 WHEN 'orta' THEN 2 WHEN 'yuksek' THEN 3 WHEN 'kritik' THEN 4 ELSE 0 END + CASE type WHEN 'buyuk_dosya' THEN 7 WHEN 'fazla_bagimlilik' THEN 3 WHEN 'sinif_eksik' THEN 5 WHEN 'decorator_eksik' THEN 2 WHEN 'parse_hatasi' THEN 10 ELSE 1 END)"


@query(f"WITH {FACTS} SELECT path, aktiflik, gereklilik, kod_kalitesi, butunluk, toplam FROM scores")
def file_scores(spark, sf_dir):
    """Q1-Q5, X13"""
    return quality.scored(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT path, type, severity, kritik, detail FROM issues")
def rule_issues(spark, sf_dir):
    """Q6-Q10, F9, U7, X15"""
    return quality.count_issues(facts(spark, sf_dir)).select("path", "type", "severity", "kritik", "detail")


@query(f"WITH {FACTS} SELECT type, count(*) AS n FROM issues GROUP BY type")
def issue_histogram(spark, sf_dir):
    """A9"""
    return quality.histogram(quality.count_issues(facts(spark, sf_dir)))


@query(f"WITH {FACTS} SELECT path, type, severity, kritik, {PRIORITY}::INTEGER AS priority FROM issues ORDER BY priority DESC, path, type, detail LIMIT 20")
def top_actions(spark, sf_dir):
    """O3, O7, Q17"""
    return quality.top_actions(quality.count_issues(facts(spark, sf_dir))).select("path", "type", "severity", "kritik", "priority")


@query(f"WITH {FACTS} SELECT round(avg(aktiflik), 1) AS aktiflik, round(avg(gereklilik), 1) AS gereklilik, round(avg(kod_kalitesi), 1) AS kod_kalitesi, round(avg(butunluk), 1) AS butunluk, round(avg(toplam), 1) AS toplam FROM scores")
def score_breakdown(spark, sf_dir):
    """A8"""
    return quality.breakdown(quality.scored(facts(spark, sf_dir)))


@query(f"WITH {FACTS}, i AS (SELECT path, count(*) AS n, count(*) FILTER (kritik) AS k FROM issues GROUP BY path) SELECT count(*) AS total_files, coalesce(sum(n), 0)::BIGINT AS total_issues, coalesce(sum(k), 0)::BIGINT AS kritik_issues, round(avg(toplam), 1) AS avg_toplam FROM scores LEFT JOIN i USING (path)")
def quality_summary(spark, sf_dir):
    """A10"""
    return quality.summary(quality.judged(facts(spark, sf_dir)))


@query(f"WITH {FACTS}, i AS (SELECT path, count(*) AS n, count(*) FILTER (kritik) AS k FROM issues GROUP BY path) SELECT {SUB} AS subsystem, count(*) AS files, round(sum(toplam), 1) AS total, coalesce(sum(n), 0)::BIGINT AS issues, coalesce(sum(k), 0)::BIGINT AS kritik, round(avg(toplam), 1) AS avg_toplam FROM scores LEFT JOIN i USING (path) GROUP BY 1")
def quality_by_subsystem(spark, sf_dir):
    """A7"""
    return quality.by_subsystem(quality.judged(facts(spark, sf_dir))).withColumn("total", F.round("total", 1))


@query(f"""WITH {FILES}, h AS (SELECT source, path, 'missing ' || lang AS detail, row_number() OVER (PARTITION BY source ORDER BY path) AS rn, count(*) OVER (PARTITION BY source) AS n FROM f)
SELECT source, path, CASE WHEN rn > 10 THEN '... ve ' || (n - 10) || ' fonksiyon daha tür ipucu eksik' ELSE detail END AS detail FROM h WHERE rn <= 11""")
def hint_overflow(spark, sf_dir):
    """Ten rows, and one for the rest; Q16 uses it on functions without hints"""
    return quality.overflow(files(spark, sf_dir).select("source", "path", F.concat(F.lit("missing "), "lang").alias("detail")), "source", ["path"], 10)


# ---- twins


@query("SELECT * FROM (SELECT md5(coalesce(text, ''))[1:12] AS key, count(*) OVER (PARTITION BY coalesce(text, '')) AS n, doc_id FROM documents) WHERE n > 1")
def twins_exact(spark, sf_dir):
    """A row for each member, with the size of its group"""
    return twins.membership(files(spark, sf_dir), names.short_hash("text"), "doc_id")


KIND = "CASE WHEN line = '' THEN 'Empty' WHEN contains(line, '|') THEN 'Table' WHEN regexp_matches(line, '[0-9]') THEN 'Number' ELSE 'Text' END"


@query(f"""WITH {FILES}, l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f))),
k AS (SELECT doc_id, list({KIND} ORDER BY i) AS kinds FROM l GROUP BY doc_id),
s AS (SELECT doc_id, array_to_string(kinds, '|') || '(' || len(list_distinct(kinds)) || ')' AS shape FROM k WHERE len(kinds) >= 3)
SELECT * FROM (SELECT shape, count(*) OVER (PARTITION BY shape) AS n, doc_id FROM s) WHERE n > 1""")
def twins_shape(spark, sf_dir):
    """A row for each member, with the size of its group"""
    kind = lambda x: F.when(x == "", "Empty").when(F.contains(x, F.lit("|")), "Table").when(x.rlike("[0-9]"), "Number").otherwise("Text")
    rows = files(spark, sf_dir).withColumn("kinds", F.transform(F.split("text", "\n"), kind)).filter(F.size("kinds") >= twins.LEAST)
    return twins.membership(rows, names.shape("kinds", F.size(F.array_distinct("kinds"))), "doc_id").withColumnRenamed("key", "shape")


@query("""WITH w AS (SELECT p_brand, p_name, list_distinct(string_split(p_name, '')) AS ws FROM (SELECT DISTINCT p_brand, p_name FROM part))
SELECT a.p_brand, a.p_name AS a, b.p_name AS b, round(100.0::DOUBLE * len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 1) AS similarity FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_name < b.p_name""")
def pairwise_jaccard(spark, sf_dir):
    """Names of a brand, which number 64 at most"""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().withColumn("letters", F.array_distinct(F.split("p_name", "")))
    return twins.pair_similarity(rows, "p_brand", "p_name", "letters")


@query("""WITH m AS (SELECT md5(split_part(coalesce(text, ''), ' ', 1)) AS g, false AS is_new FROM documents UNION ALL SELECT md5(split_part(coalesce(text, ''), ' ', 1)), true FROM benchmark)
SELECT g, count(*) FILTER (is_new) AS n_new, count(*) FILTER (NOT is_new) AS n_old FROM m GROUP BY g HAVING count(*) FILTER (is_new) > 0 AND count(*) FILTER (NOT is_new) > 0""")
def duplicate_gate(spark, sf_dir):
    """First words that benchmark items share with documents"""
    head = F.md5(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1))).alias("g")
    old, new = table(spark, sf_dir, "documents").select(head, F.lit(False).alias("is_new")), table(spark, sf_dir, "benchmark").select(head, F.lit(True).alias("is_new"))
    return twins.gate(old.union(new), "g", "is_new")


# ---- graphs

HREF = 'href="/([^"]*)"'


def links(spark, sf_dir) -> DataFrame:
    """Links of pages: from the page's host to the word that is linked."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.regexp_extract("url", r"://([^/]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))


LINKS = f"e AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS src, unnest(regexp_extract_all(html, '{HREF}', 1)) AS dst FROM pages)"


@query(f"WITH {LINKS} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def link_edges(spark, sf_dir):
    """Links of pages, counted"""
    return links(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT h AS path, coalesce(targets, []) AS targets FROM (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS h FROM pages) LEFT JOIN (SELECT src, list_sort(list(DISTINCT dst)) AS targets FROM e GROUP BY src) ON h = src")
def adjacency(spark, sf_dir):
    """A4, A21"""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/]+)", 1).alias("path"))
    return graph.adjacency(links(spark, sf_dir), hosts)


@query(f"WITH {LINKS}, n AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS path FROM pages UNION SELECT dst FROM e) SELECT path, coalesce(targets, []) AS targets FROM n LEFT JOIN (SELECT dst, list_sort(list(DISTINCT src)) AS targets FROM e GROUP BY dst) ON path = dst")
def reverse_adjacency(spark, sf_dir):
    """A5, T3"""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/]+)", 1).alias("path"))
    return graph.reverse_adjacency(links(spark, sf_dir), hosts)


def trade(spark, sf_dir) -> DataFrame:
    """Line items as edges between the nations of customer and supplier, each in its region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("R"), "n_regionkey").alias("region"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    c, s = nation.toDF("c_nationkey", "src", "src_area"), nation.toDF("s_nationkey", "dst", "dst_area")
    return rows.join(c, "c_nationkey").join(s, "s_nationkey").select("src", "dst", "src_area", "dst_area")


TRADE = "e AS (SELECT c.n_name AS src, s.n_name AS dst, 'R' || c.n_regionkey AS src_area, 'R' || s.n_regionkey AS dst_area FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey)"


@query(f"WITH {TRADE} SELECT src_area, dst_area, count(*) AS n FROM e WHERE src_area <> dst_area GROUP BY src_area, dst_area")
def subsystem_matrix(spark, sf_dir):
    """A6, T6"""
    return graph.matrix(trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT src_area, {', '.join(f'count(*) FILTER (dst_area = {chr(39)}R{k}{chr(39)} AND src_area <> dst_area) AS R{k}' for k in range(5))} FROM e GROUP BY src_area")
def subsystem_matrix_wide(spark, sf_dir):
    """A6, K7"""
    return graph.wide(graph.matrix(trade(spark, sf_dir)), [f"R{k}" for k in range(5)])


@query(f"WITH {LINKS} SELECT dst, count(DISTINCT src) AS in_degree FROM e GROUP BY dst ORDER BY in_degree DESC, dst LIMIT 15")
def hubs(spark, sf_dir):
    """A14, O1"""
    return graph.hubs(links(spark, sf_dir))


@query(f"""WITH {LINKS}, a AS (SELECT split_part(src, '.', -1) AS s, lower(substr(dst, 1, 1)) AS d FROM e), x AS (SELECT DISTINCT s, d FROM a WHERE s <> d), n AS (SELECT s AS area FROM a UNION SELECT d FROM a),
t AS (SELECT area, (SELECT count(*) FROM x WHERE s = area) AS imports_others, (SELECT count(*) FROM x WHERE d = area) AS imported_by FROM n)
SELECT area, imports_others, imported_by, (row_number() OVER (ORDER BY imported_by DESC, imports_others, area) - 1)::INTEGER AS level FROM t""")
def layers(spark, sf_dir):
    """A15, W1, W6, G7"""
    edges = links(spark, sf_dir).select(F.split_part("src", F.lit("."), F.lit(-1)).alias("src_area"), F.lower(F.substring("dst", 1, 1)).alias("dst_area"))
    return graph.layers(edges)


def touched(spark, sf_dir) -> DataFrame:
    """All events as edges from the user to the key in props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("n"), "user_id").alias("src"), F.concat(F.lit("n"), k).alias("dst"))


TOUCHED = "e AS (SELECT DISTINCT 'n' || user_id AS src, 'n' || (props::JSON ->> '$.k') AS dst FROM events)"
CLOSURE = f"WITH RECURSIVE {TOUCHED}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(f"{CLOSURE} SELECT src, dst FROM r")
def reachability(spark, sf_dir):
    """G1"""
    return graph.reachable(touched(spark, sf_dir))


@query(f"{CLOSURE}, m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src) SELECT list_sort(list(node)) AS members FROM m GROUP BY component")
def scc(spark, sf_dir):
    """G1, O6"""
    return graph.cycles(touched(spark, sf_dir))


@query(f"WITH {TRADE.replace('e AS (', 't AS (', 1)}, e AS (SELECT DISTINCT src_area AS src, dst_area AS dst FROM t), p1 AS (SELECT [src, dst] AS path FROM e WHERE src = 'R0' AND src <> dst), p2 AS (SELECT list_append(path, dst) AS path FROM p1 JOIN e ON path[-1] = src WHERE NOT list_contains(path, dst)), p3 AS (SELECT list_append(path, dst) AS path FROM p2 JOIN e ON path[-1] = src WHERE NOT list_contains(path, dst)) SELECT path FROM p1 UNION ALL SELECT path FROM p2 UNION ALL SELECT path FROM p3")
def bounded_paths(spark, sf_dir):
    """Simple paths from a node, to a depth that the caller gives; their number grows with it"""
    edges = trade(spark, sf_dir).select(F.col("src_area").alias("src"), F.col("dst_area").alias("dst"))
    return graph.bounded_paths(edges, spark.createDataFrame([("R0",)], "node string"), 3)


@query(f"WITH {LINKS} SELECT DISTINCT 'dependent' AS role, src AS node FROM e WHERE dst = 'the' UNION SELECT 'dependency', dst FROM e WHERE src = 'the'")
def direct_impact(spark, sf_dir):
    """J16, L3"""
    return graph.neighbours(links(spark, sf_dir), "the")


CALLS = "c AS (SELECT * FROM (SELECT user_id, event_type || '_' || user_id % 5 AS caller, lead(event_type || '_' || user_id % 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events) WHERE callee IS NOT NULL)"


@query(f"""WITH {CALLS}, n AS (SELECT DISTINCT event_type || '_' || user_id % 5 AS name FROM events), o AS (SELECT caller, list_sort(list(DISTINCT callee)) AS callees FROM c GROUP BY caller), i AS (SELECT callee, list_sort(list(DISTINCT caller)) AS callers FROM c GROUP BY callee)
SELECT name, coalesce(callees, []) AS callees, list_filter(coalesce(callers, []), lambda x: x <> name) AS callers, list_contains(coalesce(callers, []), name) AS self_recursive FROM n LEFT JOIN o ON name = caller LEFT JOIN i ON name = callee""")
def callers_callees(spark, sf_dir):
    """Each event calls its user's next one"""
    name = F.concat_ws("_", "event_type", F.col("user_id") % 5)
    rows = table(spark, sf_dir, "events").select("user_id", name.alias("caller"), F.lead(name).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("callee"))
    return graph.callers(rows.filter("callee is not null").select("caller", "callee"), rows.select(F.col("caller").alias("name")))


@query("""WITH f AS (SELECT p_partkey AS ord, p_brand || '.' || replace(p_name, ' ', '.') AS qname FROM part), k AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS callee, p_type AS caller FROM part)
SELECT DISTINCT caller, coalesce((SELECT arg_min(qname, ord) FROM f WHERE qname = callee OR ends_with(qname, '.' || callee)), callee) AS callee FROM k""")
def resolved_calls(spark, sf_dir):
    """Last parts of qualified names"""
    part = table(spark, sf_dir, "part")
    known = part.select(F.concat_ws(".", "p_brand", F.replace("p_name", F.lit(" "), F.lit("."))).alias("qname"), F.col("p_partkey").alias("ord"))
    calls = part.select(F.col("p_type").alias("caller"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("callee")).distinct()
    return graph.resolve_calls(calls, known)


# ---- lookups and other join shapes


@query("""WITH u AS (SELECT DISTINCT regexp_extract(url, '://([^?#]+)', 1) AS item FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '://([^/]+/[^/?#]+)', 1) AS prefix, 2 AS prio FROM pages UNION SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1), 1 FROM pages)
SELECT item, arg_max(prefix, length(prefix)) AS target FROM u JOIN p ON item = prefix OR starts_with(item, prefix || '/') WHERE prefix <> '' GROUP BY item""")
def longest_prefix(spark, sf_dir):
    """Urls to the deepest known site or section"""
    pages = table(spark, sf_dir, "pages")
    part = lambda p, prio: pages.select(F.regexp_extract("url", p, 1).alias("prefix"), F.lit(prio).alias("prio")).filter("prefix <> ''").distinct()
    known = part(r"://([^/]+/[^/?#]+)", 2).union(part(r"://([^/]+)", 1)).select("prefix", F.col("prefix").alias("target"), "prio")
    return joins.longest_prefix(pages.select(F.regexp_extract("url", r"://([^?#]+)", 1).alias("item")), "item", known, "/")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^?#]+)', 1) AS path FROM pages), w AS (SELECT DISTINCT regexp_extract(url, '([^/]+/[^/?#]+)$', 1) AS wanted FROM pages)
SELECT wanted, arg_min(path, (path <> wanted)::INTEGER || path) AS path, count(*) AS candidates FROM w JOIN p ON path = wanted OR ends_with(path, '/' || wanted) WHERE wanted <> '' GROUP BY wanted""")
def suffix_lookup(spark, sf_dir):
    """J6, L2"""
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select(F.regexp_extract("url", "([^/]+/[^/?#]+)$", 1).alias("wanted")).filter("wanted <> ''").distinct()
    return joins.suffix_lookup(pages.select(F.regexp_extract("url", r"://([^?#]+)", 1).alias("path")), "path", wanted, "wanted")


@query("""WITH p AS (SELECT user_id AS key, event_id AS pt FROM events WHERE event_type = 'error'), s AS (
  SELECT user_id AS key, event_id AS start, event_id + 400 AS stop, 'v' || event_id AS name FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, event_id + 4000, 's' || event_id FROM events WHERE event_type = 'signup'),
i AS (SELECT p.key, p.pt, arg_max(name, start) AS name FROM p JOIN s ON p.key = s.key AND p.pt BETWEEN s.start AND s.stop GROUP BY p.key, p.pt)
SELECT key, name, min(pt) AS pt FROM i GROUP BY key, name""")
def interval_innermost(spark, sf_dir):
    """Errors to the latest view or signup that spans them, and the first of each"""
    events = table(spark, sf_dir, "events")
    points = events.filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("pt"))
    span = lambda kind, letter, n: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("start"), (F.col("event_id") + n).alias("stop"), F.concat(F.lit(letter), "event_id").alias("name"))
    found = joins.innermost(points, span("view", "v", 400).union(span("signup", "s", 4000)), "key", "pt", "start", "stop", "name")
    return snapshots.first_changes(found, "key", "name", line="pt")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INTEGER AS asked FROM conversations")
def last_non_null(spark, sf_dir):
    """The length of the user's last turn"""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.char_length("text")).alias("own"))
    return joins.forward_fill(turns, "own", "turn", "asked", "conv_id").drop("own")


@query("""WITH n AS (SELECT DISTINCT lower(p_type) AS declared FROM part UNION SELECT 'ring-kit' UNION SELECT 'pyyaml'), i AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS imported FROM part UNION SELECT 'yaml')
SELECT declared FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE replace(declared, '-', '_') = imported OR contains(replace(declared, '-', '_'), imported) OR contains(imported, replace(declared, '-', '_')))""")
def theta_anti(spark, sf_dir):
    """Part types that no word of a name lies in, or contains"""
    part = table(spark, sf_dir, "part")
    extra = spark.createDataFrame([("ring-kit",), ("pyyaml",)], "declared string")
    declared = part.select(F.lower("p_type").alias("declared")).union(extra).distinct().withColumn("norm", names.normal_name("declared"))
    imported = part.select(F.explode(F.split("p_name", " ")).alias("imported")).union(spark.createDataFrame([("yaml",)], "imported string")).distinct()
    return declared.join(joins.related(declared, imported, "norm", "imported"), "norm", "left_anti").select("declared")


@query("WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red widget' THEN 0 WHEN contains(lower(p_name), 'red widget') THEN 1 END AS c FROM part) SELECT p_partkey, p_name FROM s WHERE c = (SELECT min(c) FROM s)")
def find_symbol(spark, sf_dir):
    """Exact matches, else partial ones"""
    name = F.lower("p_name")
    return joins.best_class(table(spark, sf_dir, "part").select("p_partkey", "p_name"), name == "red widget", F.contains(name, F.lit("red widget"))).orderBy("p_name", "p_partkey")


@query("""SELECT name, kind, printf('%-30s %-8s %s', name, kind, place) AS line FROM (SELECT r_name AS name, 'region' AS kind, r_regionkey::VARCHAR AS place FROM region UNION ALL SELECT n_name, 'nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT s_name, 'supplier', s_suppkey::VARCHAR FROM supplier)""")
def symbol_index(spark, sf_dir):
    """Lines of fixed width"""
    part = lambda t, name, key, kind: table(spark, sf_dir, t).select(F.col(name).alias("name"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("place"))
    rows = part("region", "r_name", "r_regionkey", "region").unionByName(part("nation", "n_name", "n_nationkey", "nation")).unionByName(part("supplier", "s_name", "s_suppkey", "supplier"))
    return rows.select("name", "kind", F.format_string("%-30s %-8s %s", "name", "kind", "place").alias("line")).orderBy(F.lower("name"), "line")


@query("""WITH c AS (SELECT p_type AS path, p_name AS name, p_partkey::INTEGER AS lineno, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS other, p_name AS own FROM part),
m AS (SELECT path, name, lineno, other AS base FROM c UNION ALL SELECT path, name, lineno, own FROM c), n AS (SELECT base, count(*) AS n FROM m GROUP BY base),
k AS (SELECT c.path AS base_path, base, lineno AS base_line, n FROM c JOIN n ON base = name ORDER BY n DESC, base, base_path, base_line LIMIT 50),
f AS (SELECT base, list(name ORDER BY rn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path, lineno, name) AS rn FROM m) WHERE rn <= 5 GROUP BY base)
SELECT base_path, k.base, base_line, n, first FROM k JOIN f ON k.base = f.base WHERE n >= 2""")
def polymorphic_map(spark, sf_dir):
    """Parts as classes, of which many have one name; the limit comes before the filter"""
    from ..operators.insights import most_extended

    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("lineno"), F.array(F.concat(F.lit("base."), turned), F.col("p_name")).alias("bases"))
    return most_extended(parts).withColumn("first", F.transform("first", lambda m: m["sub"]))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (event_type <> 'error' AND event_type <> 'signup') AS ok, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'click') AS expected FROM events GROUP BY user_id)
SELECT user_id, ok, failed, expected, CASE WHEN failed > 0 THEN 'FAIL' WHEN ok + failed <> expected THEN 'UNKNOWN' ELSE 'OK' END AS state,
  CASE WHEN ok + failed <> expected THEN 'Raporlanan ' || (ok + failed) || '/' || expected || ' modul - alt islem ciktisi kesildi veya kilitlenme oldu; yukaridakiler guvenilir, geri kalani dogrulanamadi.' END AS note FROM h""")
def health_lines(spark, sf_dir):
    """Signups give lines that say nothing, and clicks are reported without being expected"""
    from ..operators.insights import health

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("subsystem"), "event_type")
    word = F.when(F.col("event_type") == "error", "FAIL ").when(F.col("event_type") == "signup", "(no modules) ").otherwise("OK ")
    return health(events.select("subsystem", F.concat(word, "event_type").alias("line")), events.filter("event_type <> 'click'")).withColumnRenamed("subsystem", "user_id")


@query(f"WITH {FILES} SELECT path FROM f WHERE NOT contains(path, '/')")
def base_entries(spark, sf_dir):
    """F10"""
    return files(spark, sf_dir).filter(F.instr("path", "/") == 0).select("path")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def recent_topk(spark, sf_dir):
    """The last three orders of each customer"""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", rank).filter("rn <= 3").drop("rn")


@query("""WITH p AS (SELECT DISTINCT string_split(regexp_extract(url, '://([^?#]+)', 1), '/') AS s FROM pages), x AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS prefix, s[i] AS name, (i - 1)::INTEGER AS depth, i = len(s) AS is_file FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p))
SELECT prefix, name, depth, is_file, repeat('  ', depth) || name || CASE WHEN is_file THEN '' ELSE '/' END AS line FROM x""")
def tree_paths(spark, sf_dir):
    """K6, G8"""
    rows = table(spark, sf_dir, "pages").select(F.explode(paths.tree_rows(F.regexp_extract("url", r"://([^?#]+)", 1))).alias("t")).select("t.*").distinct()
    return rows.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.when(F.col("is_file"), "").otherwise("/")))


@query(f"WITH {FILES} SELECT path FROM f WHERE NOT (list_contains(string_split(path, '/')[:-2], 'fr') OR starts_with(path, 'src1') AND contains(path, '/') AND NOT contains(split_part(path, '/', 1), '-') OR regexp_matches(string_split(path, '/')[-1], '^src1-.*$'))")
def ignored_paths(spark, sf_dir):
    """Folders by name and by glob, files by glob"""
    return files(spark, sf_dir).filter(~paths.ignored("path", ["fr", "src1*/", "src1-*"])).select("path")


@query("SELECT l_returnflag AS subsystem, count(*) AS files, round(sum(l_quantity) / 1048576.0, 6) AS megabytes, sum(l_quantity) > 1048576 AS over_warn FROM lineitem GROUP BY l_returnflag")
def size_guard(spark, sf_dir):
    """Sums of groups against a limit"""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("subsystem")).agg(F.count("*").alias("files"), F.sum("l_quantity").alias("bytes"))
    return rows.select("subsystem", "files", F.round(F.col("bytes") / 1048576.0, 6).alias("megabytes"), (F.col("bytes") > 1048576).alias("over_warn"))
