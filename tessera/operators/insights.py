"""Discovery: what is extended, what is imported most, and what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bases considered, subclasses that one needs, and those that its own row names.
MOST_BASES, LEAST_SUBCLASSES, NAMED = 50, 2, 5


def mentions(classes: DataFrame) -> DataFrame:
    """classes: path, name, lineno, bases. base (the simple name of a base), sub_path, sub, sub_line: a row for each base of each class."""
    each = classes.select(F.col("path").alias("sub_path"), F.col("name").alias("sub"), F.col("lineno").alias("sub_line"), F.explode("bases").alias("b"))
    return each.select("sub_path", "sub", "sub_line", F.element_at(F.split("b", r"\."), -1).alias("base"))


#: Rows of one name that a task holds against as many of the other side.
BLOCK = 2048


def subclass_pairs(classes: DataFrame) -> DataFrame:
    """Each class with each class of the tree that has the simple name of one of its bases.

    The pairs of a name grow with the square of the classes of that name, and few bytes make many. So both sides of
    a name are dealt into pieces of some BLOCK rows, each piece meets each of the other
    side, and these blocks are dealt to as many tasks as are set.
    """
    subs, bases = mentions(classes), classes.select(F.col("name").alias("base"), F.col("path").alias("base_path"), F.col("lineno").alias("base_line"))
    pieces = lambda rows, into: rows.groupBy("base").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(into))
    sizes = pieces(subs, "n_subs").join(pieces(bases, "n_bases"), "base")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = subs.join(sizes, "base").withColumn("i", F.pmod(F.hash("sub_path", "sub_line", "sub"), "n_subs")).withColumn("j", all_of("n_bases")).drop("n_subs", "n_bases")
    right = bases.join(sizes, "base").withColumn("j", F.pmod(F.hash("base_path", "base_line"), "n_bases")).withColumn("i", all_of("n_subs")).drop("n_subs", "n_bases")
    tasks, block = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["base", "i", "j"]
    return left.repartition(tasks, *block).hint("merge").join(right.repartition(tasks, *block), block).drop("i", "j")


def most_extended(classes: DataFrame) -> DataFrame:
    """base_path, base, base_line, n, first: the classes with the most subclasses, each where it stands; those with one only are dropped after the limit. Ties go by name, then place.

    Two classes of one name are two rows, and each has all classes that name it. Names are
    counted before they are joined with classes, so no list of subclasses is built; first has the least of them.
    """
    named = mentions(classes)
    counted = named.groupBy("base").agg(F.count("*").alias("n"))
    own = classes.select(F.col("path").alias("base_path"), F.col("name").alias("base"), F.col("lineno").alias("base_line"))
    chosen = own.join(counted, "base").orderBy(F.desc("n"), "base", "base_path", "base_line").limit(MOST_BASES).filter(F.col("n") >= LEAST_SUBCLASSES)
    place = F.row_number().over(W.partitionBy("base").orderBy("sub_path", "sub_line", "sub"))
    least = named.withColumn("rn", place).filter(F.col("rn") <= NAMED).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("sub_path", "sub_line", "sub"))).alias("first"))
    return chosen.join(least, "base").select("base_path", "base", "base_line", "n", "first")


def extensions(classes: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: rows of most_extended. base_path, base, base_line, sub_path, sub, sub_line: a row for each subclass of the chosen ones, MOST_BASES at most."""
    return mentions(classes).join(F.broadcast(chosen.select("base_path", "base", "base_line")), "base")


def role(level: Column, last: Column, imported_by: Column, imports_others: Column) -> Column:
    """The label of a layer; the texts are fixed values of the result."""
    return F.when(level == last, "UI/giris katmani").when(imports_others <= 1, "Kutuphane/ortak modul").when(imported_by == 0, "Ust-yapi/konfigurasyon").otherwise("Servis/is mantigi")


def health(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """lines: subsystem, line (OK ... or FAIL ...; others say nothing of a module). modules: subsystem, one row for each module that should be reported.

    For each subsystem how many are ok, failed and expected, the state (FAIL if one
    failed, UNKNOWN if fewer or more are reported than expected), and a note if so; the
    text of the note is a fixed value of the result.
    """
    starts = lambda word: F.count_if(F.startswith("line", F.lit(word)))
    said = lines.groupBy("subsystem").agg(starts("OK").alias("ok"), starts("FAIL").alias("failed"))
    wanted = modules.groupBy("subsystem").agg(F.count("*").alias("expected"))
    both = wanted.join(said, "subsystem", "full_outer").na.fill(0, ["ok", "failed", "expected"])
    reported = F.col("ok") + F.col("failed")
    state = F.when(F.col("failed") > 0, "FAIL").when(reported != F.col("expected"), "UNKNOWN").otherwise("OK")
    note = F.format_string("Raporlanan %d/%d modul - alt islem ciktisi kesildi veya kilitlenme oldu; yukaridakiler guvenilir, geri kalani dogrulanamadi.", reported, F.col("expected"))
    return both.select("subsystem", "ok", "failed", "expected", state.alias("state"), F.when(reported != F.col("expected"), note).alias("note"))


def failing(lines: DataFrame) -> DataFrame:
    return lines.filter(F.startswith("line", F.lit("FAIL")))
