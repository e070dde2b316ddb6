"""Join shapes against brute force, and how many rows they make where one key holds all."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins

SPAN = "k string, s long, e long, name string"


def slow_innermost(points, spans):
    out = set()
    for k, at in set(points):
        around = [(s, n) for key, s, e, n in spans if key == k and None not in (k, at, s, e) and s <= at <= e]
        if around:
            out.add((k, at, max(around)[1]))
    return sorted(out)


@pytest.mark.parametrize("few", [0, 100, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_innermost_against_all_pairs(spark, monkeypatch, seed, few):
    """Keys of few spans, of many, and of both kinds in one table."""
    monkeypatch.setattr(joins, "FEW_SPANS", few)
    rng = random.Random(seed)
    wide = rng.choice([20, 300, 10**12])
    spans = []
    for i in range(300):
        s = rng.randint(-wide, wide)
        spans.append((rng.choice(["a", "a", "b", None]), s, rng.choice([None, s - 1, s, s + rng.randint(0, 9), s + rng.randint(0, wide)]), f"n{i % 40}"))
    points = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, rng.randint(-wide, wide), rng.choice(spans)[1]])) for _ in range(400)]
    got = joins.innermost(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(spans, SPAN), "k", "p", "s", "e", "name")
    assert sorted(map(tuple, got.collect())) == slow_innermost(points, spans)


def test_innermost_of_one_key_makes_rows_as_points_and_spans(spark):
    """Spans that all lie in each other: every point meets half of them."""
    n = 100_000
    spans = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("s"), (2 * n - F.col("id")).alias("e"), F.col("id").cast("string").alias("name"))
    points = spark.range(n).select(F.lit("k").alias("k"), (2 * F.col("id")).alias("p"))
    made = spans.select(F.explode(joins._cells(F.col("s"), F.col("e")))).count()
    assert made < 40 * n
    got = joins.innermost(points, spans, "k", "p", "s", "e", "name")
    wrong = got.filter(F.col("name").cast("long") != F.least(F.col("p"), 2 * n - F.col("p"), F.lit(n - 1)))
    assert got.count() == n and wrong.isEmpty()


def test_cells_make_up_their_range(spark):
    rng = random.Random(5)
    rows = [(s, s + rng.randint(-1, 70)) for s in (rng.randint(-90, 90) for _ in range(200))]
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", joins._cells(F.col("s"), F.col("e")).alias("c"))
    for r in df.collect():
        inside = sorted(x for c in r.c or () for x in range(c.cell << joins.BITS * c.level, c.cell + 1 << joins.BITS * c.level))
        assert inside == list(range(r.s, r.e + 1)), r


def test_places_in_an_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["b", "", None]), f"v{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(7)
    assert sorted((r.place, r.v) for r in joins.ranked(df, ["v"], "place").collect()) == [(i + 1, v) for i, (_, v) in enumerate(sorted(rows, key=lambda r: r[1]))]
    want = []
    for k in {k for k, _ in rows}:
        want += [(str(k), i + 1, v) for i, v in enumerate(sorted((v for key, v in rows if key == k), reverse=True))]
    assert sorted((str(r.k), r.place, r.v) for r in joins.ranked(df, [F.desc("v")], "place", ["k"]).collect()) == sorted(want)
    assert joins.ranked(df.limit(0), ["v"], "place").count() == 0


def test_a_hot_key_is_ranked_by_many_tasks(spark):
    """Moves of files that all have one content: no range, which is a task's share, holds more than a few times its part."""
    n = 40_000
    side = lambda name: spark.range(n).select(F.lit("empty").alias("sha"), F.format_string(name + "%06d", "id").alias(name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = side("old").repartitionByRange("sha", "old").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        pairs = joins.rank_pairs(side("old"), side("new"), "sha", "old", "new")
        assert pairs.count() == n and pairs.filter("substring(old, 4) <> substring(new, 4)").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges < 4 * n / 16


@pytest.mark.parametrize("seed", range(3))
def test_related_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abéc") for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 6, 9]))) if rng.random() > 0.03 else None
    left, right = [name() for _ in range(60)], [name() for _ in range(rng.choice([1, 8, 40]))]
    right = [r for r in right if r != ""] if seed else right
    got = joins.related(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    want = sorted({a for a in left for b in right if a is not None and b is not None and (a in b or b in a)})
    assert sorted(r.a for r in got.collect()) == want


def test_long_names_give_few_rows(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefgh_") for _ in range(200)) for _ in range(50)]
    rows = spark.createDataFrame([(x,) for x in long], "o string").select(F.size(joins.grams(F.col("o"), joins.GRAM)).alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 200
    got = joins.containing(spark.createDataFrame([(x,) for x in long], "o string"), spark.createDataFrame([(x[50:90],) for x in long], "i string"))
    assert sorted(r.o for r in got.collect()) == sorted(long)


def test_first_rows_of_a_hot_group_and_buckets_that_are_too_large(spark):
    from tessera.operators import quality, twins

    rows = spark.range(5000).select(F.when(F.col("id") % 100 == 0, F.lit(None)).when(F.col("id") % 50 == 1, "few").otherwise("hot").alias("g"), F.format_string("d%05d", "id").alias("detail"))
    got = quality.overflow(rows, "g", ["detail"], 3)
    said = {}
    for r in got.orderBy("detail").collect():
        said.setdefault(r.g, []).append(r.detail)
    left = {None: 50 - 3, "few": 100 - 3, "hot": 4850 - 3}
    assert {g: sum(d.startswith("...") for d in ds) for g, ds in said.items()} == dict.fromkeys(left, 1)
    assert all(f"... ve {n} fonksiyon daha tür ipucu eksik" in said[g] and len(said[g]) == 4 for g, n in left.items())
    items = spark.createDataFrame([("k", i, ["a"]) for i in range(6)], "bucket string, id int, items array<string>")
    assert twins.pair_similarity(items, "bucket", "id", "items", 6).count() == 15
    with pytest.raises(Exception, match="bucket k has 6 members"):
        twins.pair_similarity(items, "bucket", "id", "items", 5).collect()
