"""Issues of sources, as expressions over the facts of one parse.

files: path and the columns of extract.FACTS. Files that do not parse have none.
The texts are fixed values of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import BRANCHES
from .quality import overflow, union_rules

CRITICAL = ("shell_injection", "pickle_load", "sql_injection")
#: The complexity from which a function is an issue, a grave one and a critical one; the share of hints, and how many are named without.
COMPLEX, GRAVE = 20, 30
HINTED_PERCENT, NAMED = 50, 10


def functions(files: DataFrame) -> DataFrame:
    """path, ord (place in the file's walk) and the fields of each function, with its complexity if its branches are among them."""
    rows = files.select("path", F.posexplode("bodies").alias("ord", "b")).select("path", "ord", "b.*")
    return rows.withColumn("complexity", complexity("branches", "operands")) if "branches" in rows.columns else rows


def complexity(branches: str, operands: str) -> Column:
    """One, each branch, and each operand of and / or after the first."""
    return F.aggregate(F.array(*map(F.lit, BRANCHES)), F.lit(1) + F.col(operands), lambda n, kind: n + F.coalesce(F.try_element_at(F.col(branches), kind), F.lit(0)))


def _issue(rows: DataFrame, kind: Column, severity: Column, kritik: Column, detail: Column, cozum: Column, line: Column) -> DataFrame:
    return rows.select("path", kind.alias("type"), severity.alias("severity"), kritik.alias("kritik"), detail.alias("detail"), cozum.alias("cozum"), line.cast("int").alias("line"))


def unreachable(known: DataFrame) -> DataFrame:
    """Each statement that follows a return or raise of the same body, once for each of these; pass and literals aside."""
    ended = known.select("path", "statements", F.posexplode("statements").alias("at", "end")).filter(F.col("end.kind").isin("Return", "Raise"))
    late = ended.select("path", "end", F.explode(F.expr("slice(statements, at + 2, size(statements))")).alias("late")).filter(~F.col("late.kind").isin("Pass", "Literal"))
    detail = F.format_string("'%s' sonrası erişilemez kod var", "end.text")
    return _issue(late, F.lit("unreachable_code"), F.lit("orta"), F.lit(False), detail, F.lit("Erişilemez kodu silin veya kontrol akışını düzeltin."), F.col("late.line"))


def unused(known: DataFrame) -> DataFrame:
    """Names that a function stores and nowhere loads, at the last store of the walk; those with a leading underscore aside."""
    name = lambda x: x["name"]
    stored = F.filter("names", lambda x: x["stored"] & ~x["name"].startswith("_"))
    loaded = F.transform(F.filter("names", lambda x: ~x["stored"]), name)
    lone = known.select("path", stored.alias("stored"), F.explode(F.array_except(F.transform(stored, name), loaded)).alias("name"))
    line = F.element_at(F.filter("stored", lambda x: x["name"] == F.col("name")), -1)["line"]
    at = lone.select("path", "name", line.alias("line"))
    detail = F.format_string("Atanan ama kullanılmayan değişken: '%s' (satır %d)", "name", "line")
    return _issue(at, F.lit("unused_variable"), F.lit("dusuk"), F.lit(False), detail, F.lit("Kullanılmayan değişkeni silin veya kullanın."), F.col("line"))


def risky(files: DataFrame) -> DataFrame:
    """One for each match of a security pattern, and one for each call of eval or exec."""
    each = files.select("path", F.explode("risks").alias("name", "n")).select("path", "name", F.explode(F.sequence(F.lit(1), "n")))
    grave = F.col("name").isin(*CRITICAL)
    matches = _issue(each, F.concat(F.lit("security_"), "name"), F.when(grave, "yuksek").otherwise("orta"), grave, F.format_string("Güvenlik riski: %s tespit edildi", "name"), F.format_string("%s kullanımını gözden geçirin, güvenli alternatif kullanın.", "name"), F.lit(None))
    calls = files.select("path", F.explode("dynamic").alias("d")).select("path", "d.*")
    said = F.format_string("Güvenlik riski: eval_exec tespit edildi ('%s()' çağrısı)", "name")
    return matches.unionByName(_issue(calls, F.lit("security_eval_exec"), F.lit("yuksek"), F.lit(True), said, F.format_string("eval/exec yerine güvenli alternatif kullanın (örn. ast.literal_eval, açık dağıtım). Satır %d.", "line"), F.col("line")))


def complex_functions(known: DataFrame) -> DataFrame:
    n = F.col("complexity")
    rows = known.filter(n > COMPLEX)
    return _issue(rows, F.lit("yuksek_ciklik"), F.when(n < GRAVE, "orta").otherwise("yuksek"), n > GRAVE, F.format_string("Fonksiyon '%s' cok karmaşık (CC=%d)", "name", "complexity"), F.lit("Fonksiyonu daha küçük parçalara bölün."), F.col("line"))


def hint_coverage(files: DataFrame) -> DataFrame:
    """path, functions, hinted, and coverage: the percentage of functions with a hint, 100 where there are none."""
    n, with_hint = F.size(F.coalesce("bodies", F.array())), F.size(F.filter(F.coalesce("bodies", F.expr("slice(bodies, 1, 0)")), lambda b: b["hinted"]))
    counted = files.select("path", n.alias("functions"), F.greatest(with_hint, F.lit(0)).alias("hinted"))
    return counted.withColumn("coverage", F.when(F.col("functions") > 0, F.round(100.0 * F.col("hinted") / F.col("functions"), 1)).otherwise(100.0))


def missing_hints(files: DataFrame, known: DataFrame) -> DataFrame:
    """Where less than half of a file's functions have hints: the first ten without, and one row for the rest."""
    poor = hint_coverage(files).filter((F.col("functions") > 0) & (100 * F.col("hinted") < HINTED_PERCENT * F.col("functions"))).select("path")
    bare = known.filter(~F.col("hinted")).join(poor, "path", "left_semi")
    rows = bare.select("path", "ord", F.lit("missing_type_hint").alias("type"), F.lit("dusuk").alias("severity"), F.lit(False).alias("kritik"), F.format_string("Fonksiyon '%s' tür ipucu eksik", "name").alias("detail"), F.lit("Fonksiyon imzasına tip ipuçları ekleyin.").alias("cozum"), F.lit(None).cast("int").alias("line"))
    made = overflow(rows, "path", ["ord"], NAMED)
    return made.withColumn("cozum", F.when(F.startswith("detail", F.lit("...")), "Fonksiyon imzalarına tip ipuçları ekleyin.").otherwise(F.col("cozum"))).drop("ord")


def found(files: DataFrame) -> DataFrame:
    """All issues that a parse shows: path, type, severity, kritik, detail, cozum, line."""
    known = functions(files)
    return union_rules([unreachable(known), unused(known), risky(files), complex_functions(known), missing_hints(files, known)])
