"""Join shapes that Spark has no operator for, as plans over equi-joins.

None of them meets all rows of a key with all others, and none puts a key's rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import prefixes
from ..plans.tables import cut


def exchanged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: rows are exchanged between tasks, and none are sent through the driver, as Spark does with a side whose files are small."""
    return left.join(right.hint("merge"), on, how)


def ranked(df: DataFrame, order: list, into: str, keys: list[str] = ()) -> DataFrame:
    """df with the place of each row in an order, from 1, among all rows or among those of equal keys; a total order gives the same places each time.

    Rows are dealt by ranges of keys and order, and each range is counted; a row's place
    is that in its range and what the ranges before hold of its keys. So a key of
    any share of the rows is numbered by many tasks; the one window over a whole key has a row for each range.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    local = F.row_number().over(W.partitionBy("__range", *keys).orderBy(*order))
    counts = placed.groupBy("__range", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(k).isNull().alias(f"__n{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__rows"))
    marks = [c for c in counts.columns if c not in ("__range", "__rows")]
    before = W.partitionBy(*marks).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    numbered = placed.withColumn("__local", local)
    for i, k in enumerate(keys):
        numbered = numbered.withColumn(f"__k{i}", F.coalesce(F.col(k).cast("string"), F.lit(""))).withColumn(f"__n{i}", F.col(k).isNull())
    return numbered.join(offsets, ["__range", *marks]).withColumn(into, F.col("__local") + F.col("__before")).drop("__range", "__local", "__before", *marks)


def rank_pairs(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Pairs the k-th row of left with the k-th of right among rows of equal key; null and empty keys pair with none.

    Keys that only one side has are left out before their rows are numbered.
    """
    left, right = left.filter(F.col(key) != ""), right.filter(F.col(key) != "")
    common = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
    numbered = lambda df, order: ranked(df.join(common, key, "left_semi"), [order], "rn", [key])
    return numbered(left, left_order).join(numbered(right, right_order), [key, "rn"]).drop("rn")


def longest_prefix(items: DataFrame, item: str, targets: DataFrame, sep: str = ".") -> DataFrame:
    """items: a column `item` of joined parts. targets: prefix, target, prio. For each distinct item the target of its longest prefix, the least prio first; items without one are left out.

    Prefixes are exploded and joined by equality, so no item meets all targets.
    """
    tried = items.select(item).distinct().select(item, F.posexplode(prefixes(item, sep)).alias("len", "prefix"))
    found = exchanged(tried, targets, "prefix")
    return found.groupBy(item).agg(F.min_by("target", F.struct(-F.col("len"), "prio", "target")).alias("target"))


#: Ranges of whole numbers are cut at multiples of 4, 16, 64 and so on: two bits a level.
BITS = 2


def _cells(start: Column, end: Column) -> Column:
    """The fewest aligned ranges (level, cell: all x with x >> 2 level = cell) that make up start to end, both included; null if that is empty."""
    stop = end + 1
    top = F.when(stop > start, ((F.char_length(F.bin(stop - start)) - 1) / BITS).cast("int"))
    low = lambda k: F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k * BITS) - 1, k * BITS)
    high = lambda k: F.call_function("shiftright", stop, k * BITS)
    four = F.lit(1 << BITS)

    def of(k: Column) -> Column:
        a, b, outer_a, outer_b = low(k), high(k), low(k + 1) * four, high(k + 1) * four
        between = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        cells = F.when((k == top) | (outer_a >= outer_b), between(a, b)).otherwise(F.concat(between(a, outer_a), between(outer_b, b)))
        return F.transform(cells, lambda c: F.struct(k.alias("level"), c.alias("cell")))

    return F.when(top.isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), top), of)))


#: Spans of a key that its points are held against one by one.
FEW_SPANS = 64


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, *keep: str) -> DataFrame:
    """For each point the name of the span of its key that contains it and starts last; of those that start together, the greatest name. keep names further columns of points; equal points are one row, those in no span none.

    Points of a key with few spans are held against these. Where a key has more than FEW_SPANS, each span is cut into aligned ranges,
    some three for each doubling of its length, and of the spans that cover a range whole only
    the innermost is kept. A point then meets at most one span for each size of range there
    is in its key, by equality: rows grow as points and spans do, however they overlap, and
    a key's rows are dealt by range. The result is the same either way.
    """
    own = spans.select(key, F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end"), F.struct(F.col(start).cast("long").alias("__start"), F.col(name).alias("__name")).alias("__best"))
    counted = own.groupBy(key).agg(F.count("*").alias("__n"))
    sized = own.join(counted, key)
    asked = points.select(key, at, *keep).distinct()
    here = F.col(at).cast("long")
    few = sized.filter(F.col("__n") <= FEW_SPANS).withColumnRenamed(key, "__key")
    near = asked.join(few, (F.col(key) == F.col("__key")) & here.between(F.col("__start"), F.col("__end"))).select(key, at, *keep, "__best")
    cut_up = sized.filter(F.col("__n") > FEW_SPANS).select(key, "__best", F.explode(_cells(F.col("__start"), F.col("__end"))).alias("__c"))
    best = cut_up.groupBy(key, "__c.level", "__c.cell").agg(F.max("__best").alias("__best"))
    longest = best.groupBy(key).agg(F.max("level").alias("__top"))
    level = F.sequence(F.lit(0), F.col("__top"))
    cells = F.transform(level, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", here, k * BITS).alias("cell")))
    met = asked.join(longest, key).select(key, at, *keep, F.explode(cells).alias("__c")).select(key, at, *keep, "__c.level", "__c.cell")
    every = near.unionByName(met.join(best, [key, "level", "cell"]).select(key, at, *keep, "__best"))
    return every.groupBy(key, at, *keep).agg(F.max("__best").alias("__best")).select(key, at, *keep, F.col("__best.__name").alias(name))


def best_class(df: DataFrame, *conditions: Column) -> DataFrame:
    """The rows that meet the first condition that any row meets: exact matches, else partial ones."""
    ranked = df.withColumn("__class", F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])).filter(F.col("__class").isNotNull())
    best = ranked.agg(F.min("__class").alias("__class"))
    return ranked.join(F.broadcast(best), "__class").drop("__class")  # one row


def suffix_keys(paths: DataFrame, path: str) -> DataFrame:
    """Each path with each of its trailing parts, so that a partial path is found by an equi-join."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, n, F.size(parts) - n + 1)))
    return paths.select("*", F.posexplode(tails).alias("__dropped", "suffix"))


def suffix_lookup(paths: DataFrame, path: str, partial: DataFrame, wanted: str) -> DataFrame:
    """For each wanted partial path the path that equals it, or the first one that ends with it after a slash."""
    found = partial.join(suffix_keys(paths.select(path).distinct(), path), F.col(wanted) == F.col("suffix"))
    return found.groupBy(wanted).agg(F.min_by(path, F.struct(F.col("__dropped") > 0, path)).alias(path), F.count("*").alias("candidates"))


def forward_fill(df: DataFrame, value: str, order: str, into: str, *keys: str) -> DataFrame:
    """The last value that is not null up to each row, by key."""
    rows = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(rows))


#: Characters of the parts by which names are found in others.
GRAM = 3


def grams(name: Column, size: int) -> Column:
    """The distinct parts of so many characters of a name."""
    n = F.char_length(name) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer, inner: one column each of distinct names, `o` and `i`. The pairs of which o contains i.

    Names of GRAM characters or more are looked for by their part that fewest outer names
    have, and compared in full; shorter ones are parts themselves. So a name of n characters
    gives at most GRAM * n + 1 rows.
    """
    every = F.concat(F.array(F.lit("")), *[grams(F.col("o"), k) for k in range(1, GRAM + 1)])
    index = outer.select("o", F.explode(every).alias("gram"))
    often = index.filter(F.char_length("gram") == GRAM).groupBy("gram").agg(F.count("*").alias("n"))
    long = inner.filter(F.char_length("i") >= GRAM).select("i", F.explode(grams(F.col("i"), GRAM)).alias("gram"))
    rated = long.join(often, "gram", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    asked = rated.filter("rare.n > 0").select("i", F.col("rare.gram").alias("gram")).unionByName(inner.filter(F.char_length("i") < GRAM).select("i", F.col("i").alias("gram")))
    return index.join(asked, "gram").filter(F.contains("o", F.col("i"))).select("o", "i")


def related(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """The distinct names of left that contain one of right's, or lie in one; nulls do neither. The empty name lies in each."""
    own, others = left.select(F.col(name).alias("own")).dropna().distinct(), right.select(F.col(other).alias("other")).dropna().distinct()
    around = containing(own.toDF("o"), others.toDF("i")).select(F.col("o").alias(name))
    inside = containing(others.toDF("o"), own.toDF("i")).select(F.col("i").alias(name))
    return around.union(inside).distinct()
