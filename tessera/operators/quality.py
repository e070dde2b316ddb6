"""Scores and issue rules over file facts, as expressions.

Facts per file: path, lines, n_imports, n_classes, n_classes_with_methods,
n_methods, n_decorated_methods, n_decorators, n_functions, parse_error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import subsystem

SCORES = ("aktiflik", "gereklilik", "kod_kalitesi", "butunluk")

# What each type of issue lowers, its weight, and the ranks of severities.
AFFECTS = {
    "buyuk_dosya": ("Gereklilik/Butunluk", 7),
    "fazla_bagimlilik": ("Aktiflik", 3),
    "sinif_eksik": ("Butunluk", 5),
    "decorator_eksik": ("Kod Kalitesi", 2),
    "parse_hatasi": ("Butunluk (tum skorlar)", 10),
    "yuksek_ciklik": ("Kod Kalitesi", 8),
    "missing_type_hint": ("Kod Kalitesi", 3),
    "unreachable_code": ("Kod Kalitesi", 4),
    "unused_variable": ("Kod Kalitesi", 2),
}
OTHER = ("Kod Kalitesi", 1)
SEVERITY = {"dusuk": 1, "orta": 2, "yuksek": 3, "kritik": 4}


def scored(facts: DataFrame, *keep: str) -> DataFrame:
    """path and the four scores of 0 to 10, with their sum, and the columns keep."""
    c = F.col
    parts = {
        "aktiflik": F.least(F.least(1.5 * c("n_imports"), F.lit(5.0)) + F.least(2.0 * c("n_classes"), F.lit(5.0)), F.lit(10.0)),
        "gereklilik": F.when(c("lines") > 500, 10.0).when(c("lines") > 200, 8.0).when(c("lines") > 50, 6.0).when(c("lines") > 10, 4.0).otherwise(2.0),
        "kod_kalitesi": F.least(5.0 + c("n_classes_with_methods") + 0.5 * c("n_decorated_methods"), F.lit(10.0)),
        "butunluk": F.least(F.when(c("n_classes") > 0, 4.0).otherwise(0.0) + F.when(c("n_methods") > 0, 3.0).otherwise(0.0) + F.when(c("n_functions") > 0, 2.0).otherwise(0.0) + F.when(c("n_imports") > 0, 1.0).otherwise(0.0), F.lit(10.0)),
    }
    rounded = facts.select("path", *[F.round(e.cast("double"), 1).alias(n) for n, e in parts.items()], *keep)
    return rounded.withColumn("toplam", F.round(sum((c(n) for n in SCORES[1:]), c(SCORES[0])), 1))


@dataclass(frozen=True)
class Rule:
    type: str
    when: Column
    severity: Column
    kritik: Column
    detail: Column
    cozum: str


def rules() -> list[Rule]:
    """The rules on counts. The texts are fixed values of the result."""
    c, low, no = F.col, F.lit("dusuk"), F.lit(False)
    say = lambda form, *cols: F.format_string(form, *[c(x) for x in cols])
    return [
        Rule("buyuk_dosya", c("lines") > 1000, F.when(c("lines") > 1500, "kritik").otherwise("orta"), c("lines") > 1500, say("%d satir - tek dosyada cok fazla sorumluluk (SRP ihlali)", "lines"), "Dosyayi birden fazla module bolun."),
        Rule("fazla_bagimlilik", c("n_imports") > 20, low, no, say("%d import - fazla dis bagimlilik", "n_imports"), "Gereksiz importlari temizleyin, ortak bagimliliklari toplayin."),
        Rule("sinif_eksik", (c("n_classes") == 0) & (c("n_functions") > 5), low, no, say("Sadece %d fonksiyon, 0 sinif - OOP icin sinif dusunulebilir", "n_functions"), "Ilgili fonksiyonlari bir sinif altinda toplamayi degerlendirin."),
        Rule("decorator_eksik", (c("n_methods") > 5) & (c("n_decorators") == 0), low, no, say("%d metod var ama 0 decorator", "n_methods"), "@staticmethod/@classmethod/@property ve ozel decoratorler dusunun."),
        Rule("parse_hatasi", c("parse_error"), F.lit("kritik"), F.lit(True), F.lit("Dosya AST ile parse edilemiyor (SyntaxError)"), "Syntax hatasini duzeltin."),
    ]


ISSUE = ("path", "type", "severity", "kritik", "detail", "cozum", "line")


def count_issues(facts: DataFrame, ruleset: list[Rule] | None = None) -> DataFrame:
    """One row per file and rule that it breaks. All rules are tried in one pass over the files."""
    found = [F.when(r.when, F.struct(F.lit(r.type).alias("type"), r.severity.alias("severity"), r.kritik.alias("kritik"), r.detail.alias("detail"), F.lit(r.cozum).alias("cozum"), F.lit(None).cast("int").alias("line"))) for r in ruleset or rules()]
    return facts.select("path", F.explode(F.array_compact(F.array(*found))).alias("i")).select("path", "i.*")


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def _weights(values: dict[str, object], key: str, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(key)], F.lit(default))


def priority() -> Column:
    return F.when(F.col("kritik"), 1000).otherwise(0) + 20 * _weights(SEVERITY, "severity", 0) + _weights({k: w for k, (_, w) in AFFECTS.items()}, "type", OTHER[1])


def top_actions(issues: DataFrame, most: int = 20) -> DataFrame:
    """The most urgent issues with the score that each would improve. Ties go by path, line, type, detail."""
    ranked = issues.withColumn("priority", priority()).orderBy(F.desc("priority"), "path", F.asc_nulls_first("line"), "type", "detail").limit(most)
    return ranked.withColumn("iyilestirilen_skor", _weights({k: a for k, (a, _) in AFFECTS.items()}, "type", OTHER[0]))


def judged(facts: DataFrame) -> DataFrame:
    """path, scores, and the numbers of issues and critical ones by the rules on counts, in one pass over the files."""
    broken = [F.when(r.when, F.when(r.kritik, 1).otherwise(0)) for r in rules()]
    counts = facts.select("path", F.size(F.array_compact(F.array(*broken))).cast("long").alias("issues"), F.aggregate(F.array_compact(F.array(*broken)), F.lit(0).cast("long"), lambda n, x: n + x).alias("kritik"), *[c for c in facts.columns if c != "path"])
    return scored(counts, "issues", "kritik")


def with_issues(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """scores with the numbers of issues and critical ones of a table of issues of any kind."""
    per_file = issues.groupBy("path").agg(F.count("*").alias("issues"), F.count_if("kritik").alias("kritik"))
    return scores.join(per_file, "path", "left").na.fill(0, ["issues", "kritik"])


def by_subsystem(files: DataFrame) -> DataFrame:
    """files: path, toplam, issues, kritik."""
    joined = files.withColumn("subsystem", subsystem("path"))
    return joined.groupBy("subsystem").agg(F.count("*").alias("files"), F.sum("toplam").alias("total"), F.sum("issues").alias("issues"), F.sum("kritik").alias("kritik"), F.round(F.avg("toplam"), 1).alias("avg_toplam"))


def breakdown(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 1).alias(s) for s in (*SCORES, "toplam")])


def summary(files: DataFrame) -> DataFrame:
    """files: path, toplam, issues, kritik. One row for all."""
    none = lambda e: F.coalesce(e, F.lit(0))
    return files.agg(F.count("*").alias("total_files"), none(F.sum("issues")).alias("total_issues"), none(F.sum("kritik")).alias("kritik_issues"), F.round(F.coalesce(F.avg("toplam"), F.lit(0.0)), 1).alias("avg_toplam"))


def overflow(rows: DataFrame, group: str, order: list[str], most: int, text: str = "detail") -> DataFrame:
    """The first rows of each group, and one row that says how many more there are.

    Groups are counted apart from their first rows, of which each task passes on no more than are shown.
    """
    from pyspark.sql import Window as W

    first = rows.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__rn") <= most + 1)
    counted = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    more = F.format_string("... ve %d fonksiyon daha tür ipucu eksik", F.col("__n") - most)
    both = first.join(counted, F.col(group).eqNullSafe(F.col("__group")))
    return both.withColumn(text, F.when(F.col("__rn") > most, more).otherwise(F.col(text))).drop("__rn", "__n", "__group")


def union_rules(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
