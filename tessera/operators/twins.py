"""Twins: functions that are copies by normalized hash, or alike by statement kinds.

Functions: path, line, name, kinds array<string>, argc, norm_hash. A group is one row with
its size and first members; all members are rows of a table of their own, so that a group
may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fuzzy_base, shape
from .joins import ranked

#: Statements that a function needs to be compared.
LEAST = 3

# Fixed texts of the result, by similarity.
ADVICE = (
    (95, "Birebir / cok az farkla kopyalanmis govde. Tek kaynak birakip digerlerini o kaynaga yonlendirin: ayni dosya icindeyse ortak helper + parametre; farkli dosyalardaysa ortak bir dikey dosyaya (util/helper) tasiyin. `find_*`/`apply_*`/`run_*` gibi sadece adi farkli kopyalar da ayni kurala tabidir."),
    (75, "Ortak govde, kucuk davranis farklari var. Farkli kisimlari bir `mode/strategy` parametresine (veya kucuk bir callback'e) alip tek fonksiyonda birlestirin. Varyantlar ayni girdiye ayni ciktiyi vermek zorundaysa birlestirme guvenlidir; aksi halde once cagrilarin hangi varyanti kullandigini callgraph'tan kontrol edin."),
    (0, "Yapisal benzerlik ama davranis farkli. Sorumluluklari netlestirin: ya gercek ortak kisim cikarilir, ya da bilincli olarak ayrilir - ancak bu seviyede birlesirmeden once hangi cagrinin hangi varyanti kullandigini callgraph ile dogrulayin."),
)


#: Members that a group's own row names.
NAMED = 5


def remediation(similarity: Column, count: Column, members: Column) -> Column:
    """The advice for a group; names the first five members."""
    place = F.array_join(F.transform(F.slice(members, 1, NAMED), lambda m: F.concat(F.lit("`"), m.path, F.lit(":"), m.line.cast("string"), F.lit("`"))), ", ")
    advice = F.when(similarity >= ADVICE[0][0], ADVICE[0][1]).when(similarity >= ADVICE[1][0], ADVICE[1][1]).otherwise(ADVICE[2][1])
    return F.format_string("[%d kopya, benzerlik ~%s%%] %s Bunlarla baslayin: %s", count, similarity.cast("string"), advice, place)


def classes(rows: DataFrame, key: Column) -> DataFrame:
    """key, n: the keys that two rows or more share."""
    return rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def membership(rows: DataFrame, key: Column, *member: str) -> DataFrame:
    """key, n and the columns of a member: a row for each row of a key that two or more share."""
    return rows.select(key.alias("key"), *member).join(classes(rows, key), "key")


def first_members(rows: DataFrame, key: Column, *member: str) -> DataFrame:
    """key, first: the least members of each key, NAMED at most; each task passes on no more of a key than that."""
    place = F.row_number().over(W.partitionBy("key").orderBy(*member))
    least = rows.select(key.alias("key"), *member).withColumn("rn", place).filter(F.col("rn") <= NAMED)
    return least.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*member))).alias("first"))


def similarity(sets: Column) -> Column:
    """avg and min of the Jaccard percentages of all pairs of members. sets: array of (kinds, n), the distinct sets of a group and how many members have each.

    Pairs of equal sets count by their number, so the pairs of distinct sets are all that is compared.
    """
    from ..functions.names import jaccard_percent

    def with_later(x, i):
        later = F.slice(sets, i + 2, F.size(sets))
        own = F.struct((x["n"] * (x["n"] - 1) / 2).alias("pairs"), jaccard_percent(x["kinds"], x["kinds"]).alias("value"))
        return F.concat(F.array(own), F.transform(later, lambda y: F.struct((x["n"] * y["n"]).cast("double").alias("pairs"), jaccard_percent(x["kinds"], y["kinds"]).alias("value"))))

    every = F.filter(F.flatten(F.transform(sets, with_later)), lambda p: p["pairs"] > 0)
    total = F.aggregate(every, F.lit(0.0), lambda s, p: s + p["pairs"])
    sums = F.aggregate(every, F.lit(0.0), lambda s, p: s + p["pairs"] * p["value"])
    return F.struct(F.round(F.try_divide(sums, total), 1).alias("avg"), F.array_min(F.transform(every, lambda p: p["value"])).alias("min"))


def measured(rows: DataFrame, key: Column) -> DataFrame:
    """key, similarity: of the kinds of the rows that share a key."""
    each = rows.select(key.alias("key"), F.array_sort(F.array_distinct("kinds")).alias("kinds")).groupBy("key", "kinds").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.collect_list(F.struct("kinds", "n")).alias("sets")).select("key", similarity(F.col("sets")).alias("similarity"))


def _large(functions: DataFrame) -> DataFrame:
    """The functions that are compared, with both keys."""
    by_hash = F.concat("norm_hash", F.lit("("), F.col("argc").cast("string"), F.lit(")"))
    return functions.filter(F.size("kinds") >= LEAST).select("path", "line", "name", "kinds", by_hash.alias("hash"), shape("kinds", "argc").alias("shape"))


#: The two ways to be twins: the name of the method, and the column that holds its key.
METHODS = (("hash", "hash"), ("kinds", "shape"))


def twins(functions: DataFrame) -> DataFrame:
    """A row for each group: method (hash or kinds), key, n, first (its least members), n_bases (of their names without suffixes of copies), similarity_avg, similarity_min, group_id, remediation.

    A group of kinds with the very members of a group of hashes is left out: it is one
    if all its members have one hash, and that group is as large. The similarity is that
    of the members' kinds, which is 100 for both keys, as equal hashes have equal
    kinds; it would not be for a looser key. Groups are numbered by method, size and key.
    """
    large = _large(functions)
    found = []
    for method, column in METHODS:
        key = F.col(column)
        sizes = large.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most")).filter("n > 1")
        bases = large.groupBy(key.alias("key")).agg(F.countDistinct(fuzzy_base("name")).alias("n_bases"))
        found.append(sizes.join(bases, "key").join(first_members(large, key, "path", "line", "name"), "key").join(measured(large, key), "key").withColumn("method", F.lit(method)))
    known = found[0].select(F.col("key").alias("least"), F.col("n").alias("copies"))
    other = found[1].join(known, (found[1]["least"] == known["least"]) & (found[1]["most"] == known["least"]) & (F.col("n") == F.col("copies")), "left_anti")
    both = found[0].unionByName(other)
    rated = both.select("method", "key", "n", "first", "n_bases", F.col("similarity.avg").alias("similarity_avg"), F.col("similarity.min").alias("similarity_min"))
    advised = rated.withColumn("remediation", remediation(F.col("similarity_avg"), F.col("n"), F.col("first")))
    return ranked(advised, ["method", F.desc("n"), "key"], "place").withColumn("group_id", F.format_string("TG-%03d", "place")).drop("place")


def members(functions: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, method, path, line, name, fuzzy_base: all members of all groups."""
    large = _large(functions)
    keyed = [large.select(F.lit(method).alias("method"), F.col(column).alias("key"), "path", "line", "name") for method, column in METHODS]
    return keyed[0].union(keyed[1]).join(groups.select("method", "key", "group_id"), ["method", "key"]).select("group_id", "method", "path", "line", "name", fuzzy_base("name").alias("fuzzy_base"))


#: Members of a bucket that are compared with each other.
MOST_PAIRED = 2000


def pair_similarity(rows: DataFrame, bucket: str, key: str, items: str, most: int = MOST_PAIRED) -> DataFrame:
    """Jaccard percentages of all pairs in a bucket: bucket, a, b, similarity. A bucket of more than `most` members is an error, as its pairs would grow with their square."""
    from ..functions.names import jaccard_percent

    sizes = rows.groupBy(F.col(bucket).alias("__bucket")).agg(F.count("*").alias("__n"))
    large = F.raise_error(F.format_string("bucket %s has %d members, more than %d", F.col("__bucket").cast("string"), "__n", F.lit(most)))
    fit = sizes.select("__bucket", F.when(F.col("__n") > most, large.cast("boolean")).otherwise(True).alias("__fits")).filter("__fits")
    left, right = rows.join(fit, F.col(bucket) == F.col("__bucket")).drop("__bucket", "__fits").alias("l"), rows.alias("r")
    met = left.join(right, (F.col(f"l.{bucket}") == F.col(f"r.{bucket}")) & (F.col(f"l.{key}") < F.col(f"r.{key}")))
    return met.select(F.col(f"l.{bucket}").alias(bucket), F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), jaccard_percent(F.col(f"l.{items}"), F.col(f"r.{items}")).alias("similarity"))


def gate(members: DataFrame, group: str, is_new: str) -> DataFrame:
    """Groups that have both new and existing members."""
    return members.groupBy(group).agg(F.count_if(is_new).alias("n_new"), F.count_if(~F.col(is_new)).alias("n_old")).filter("n_new > 0 and n_old > 0")
