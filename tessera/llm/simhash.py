"""Operator 9: SimHash near-duplicates by pivot distance tables.

For each distinct fingerprint the Hamming distances to reference fingerprints,
the pivots, are computed once. Some pivots lie in one of four bands of 16 bits:
less the distance to zero, the distance to such a pivot depends on its band
alone. Fingerprints at two or fewer differing bits agree in at least two of the
four bands, and so in all coordinates of those, which makes the coordinates of
every two bands a key that loses no pair. Of the pairs that share a key, those
whose coordinates for the wide pivots differ by more than two anywhere are
discarded (the triangle inequality), and the survivors are verified.

A key of more than CROWD fingerprints is not paired off. Its fingerprints are
linked through the fingerprints at one bit from them instead: two of them are at
most two bits apart exactly if they have such a neighbour, or each other, in
common, and a neighbour has 65 at most. That is exact, and linear in the crowd.

Links become components by star contraction, a few rounds of joins on written
tables; nothing but the counts of a round reaches the driver.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import discard, plain, sent_if_small, small_batches, take, written

SEED = 42
RADIUS, BANDS, BAND_BITS = 2, 4, 16
BAND_PIVOTS, WIDE_PIVOTS = 10, 8
CROWD = 64
MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivot(name: str, bits: int) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") & ((1 << bits) - 1)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def words_of(text: str | bytes | None) -> list[bytes]:
    """A-Z in lower case, cut at blanks and tabs to carriage returns; bytes.lower and bytes.split do just that."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def shingle_fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """Over the XXH64 of every shingle, repeats included; fewer words than width are one shingle, no words give zero."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    stop = ends[width - 1 :].tolist()
    start = [0, *(ends[: len(words) - width] + 1).tolist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, stop, strict=True)), np.uint64, len(stop))
    return _majority(hashes)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(shingle_fingerprint(t, width)) for t in texts.to_pylist()], pa.int64())

    return made(text.cast("binary"))


def pivot_keys(fp: Column) -> tuple[list[Column], Column]:
    """For each band the packed coordinates of its pivots, and the packed distances to the wide pivots."""
    zero = F.bit_count(fp)
    bands = []
    for b in range(BANDS):
        packed = F.lit(0).cast("long")
        for j in range(BAND_PIVOTS):
            pivot = _pivot(f"band {b} {j}", BAND_BITS) << (BAND_BITS * b)
            local = F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))) - zero + BAND_BITS
            packed = packed.bitwiseOR(F.shiftleft(local.cast("long"), 6 * j))
        bands.append(packed)
    wide = F.lit(0).cast("long")
    for j in range(WIDE_PIVOTS):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(_pivot(f"wide {j}", 64)))))
        wide = wide.bitwiseOR(F.shiftleft(distance.cast("long"), 7 * j))
    return bands, wide


def _close(x: Column, y: Column) -> Column:
    """No coordinate differs by more than the radius, and the fingerprints don't either."""
    near = F.lit(True)
    for j in range(WIDE_PIVOTS):
        at = lambda p, j=j: F.shiftright(p.wide, 7 * j).bitwiseAND(F.lit(127))
        near = near & (F.abs(at(x) - at(y)) <= RADIUS)
    return near & (F.bit_count(x.fp.bitwiseXOR(y.fp)) <= RADIUS)


def near_pairs(points: DataFrame) -> DataFrame:
    """points: family, fp, distinct. Links a < b of fingerprints of one family at RADIUS or fewer bits.

    Of the pairs in crowds, as many are given as connect what is linked; of others, all.
    """
    bands, wide = pivot_keys(F.col("fp"))
    table = points.select("family", "fp", *[c.alias(f"band{b}") for b, c in enumerate(bands)], wide.alias("wide"))
    keys = [F.xxhash64("family", F.lit(n), f"band{i}", f"band{j}") for n, (i, j) in enumerate(combinations(range(BANDS), BANDS - RADIUS))]
    rows = table.select("family", "fp", "wide", F.explode(F.array(*keys)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = written(rows.join(shared, "key"), "simhash-keys")

    def pairs(members):
        def with_later(x, i):
            later = F.slice(members, i + 2, F.size(members))
            return F.transform(F.filter(later, lambda y: _close(x, y)), lambda y: F.struct(F.least(x.fp, y.fp).alias("a"), F.greatest(x.fp, y.fp).alias("b")))

        return F.flatten(F.transform(members, with_later))

    few = rows.filter(F.col("n") <= CROWD).groupBy("key").agg(F.collect_list(F.struct("fp", "wide")).alias("members"))
    cold = few.select(F.explode(pairs(F.col("members"))).alias("pair")).select("pair.a", "pair.b").filter("a <> b")
    crowd = rows.filter(F.col("n") > CROWD).select("family", "fp").distinct()
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = crowd.select("family", "fp", F.explode(flips).alias("neighbour")).groupBy("family", "neighbour").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    hot = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    out = cold.unionByName(hot).distinct()
    out._tessera_uses = rows
    return out


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Every vertex v that has a link, with the smallest vertex of its component as root.

    Large and small stars in turn: each vertex points its larger neighbours, then
    itself and its smaller ones, at the smallest of them, until nothing changes. The
    smallest ones are written before they are joined back, so that both sides of a
    join are plain exchanges, and Spark can split the partition of a large star.
    """
    now = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v <> root").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.union(now.select("root", "v"))
        least = written(both.groupBy("v").agg(F.min("root").alias("low")).select("v", F.least("v", "low").alias("low")), "links")
        large = both.join(least, "v").filter(F.col("root") > F.col("v")).select(F.col("root").alias("v"), F.col("low").alias("root")).distinct()
        large = written(large, "links")
        low = written(large.groupBy("v").agg(F.min("root").alias("low")), "links")
        small = large.join(low, "v").select(F.col("root").alias("v"), F.col("low").alias("root")).filter("v <> root").union(low).distinct()
        small = written(small, "links")
        discard(now, large, least, low)
        now = small


def linked(points: DataFrame) -> DataFrame:
    links = near_pairs(points)
    roots = components(links)
    discard(links._tessera_uses)
    return roots


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of df: the key, its fingerprint in hex, and the smallest key of its component.

    Null, empty and blank texts have the fingerprint zero and are linked like any
    other. Repeated rows give repeated rows. A null key counts for nothing as a
    smallest key; a component of null keys only has null. An empty table gives an
    empty one; other columns are dropped.
    """
    small_batches(df.sparkSession)
    own = take(df, key, text).toDF("key", "text")
    docs = written(own.select("key", fingerprint_column(own["text"], width).alias("fp")), "simhash")
    points = written(docs.groupBy("fp").agg(F.min("key").alias("least")), "simhash-points")
    roots = linked(points.select(F.lit(0).alias("family"), "fp"))
    rooted = points.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = docs.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share so many fifths of their distinct shingles of WIDTH words, of all that either has.
WIDTH, FIFTHS = 5, 4
#: Shingles at the head of more texts than COMMON are put last, the MOST most common ones at least; an order only, which loses no pair.
COMMON, MOST = 16, 1 << 20
#: Sizes of texts that differ by less than this factor share a cell.
CELL = 1.03
#: The key of texts without words.
BLANK = 0
#: Longs of a text's parities: how often its shingles fall in each of 64 * PARITIES places, modulo 2.
PARITIES = 16
#: What is kept of a text before the shingles of its head: their number, the fingerprint of all, and the parities.
BEFORE = 2 + PARITIES


def shingle_hashes(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; fewer words than width are one shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    width = min(width, len(words))
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        rolled = each[: len(each) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - width + 1 + k]
            rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled.view(np.int64))


def _head_size(n: int) -> int:
    """Of n shingles, so many that the others are fewer than what a text shares with a near copy."""
    return n - -(-FIFTHS * n // 5) + 1


def head_of(text: str | bytes | None, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The number of shingles, their SimHash, their parities, and the first of them in the order of times, 0 for what is not in common, then of hashes.

    Texts with four fifths of their shingles in common have one of these in common, as
    each has so many that the others are fewer than what they share.
    """
    s = shingle_hashes(text)
    n = len(s)
    if not n:
        return np.array([0] * BEFORE + [BLANK], np.int64)
    odd = np.packbits(np.bincount(s & (64 * PARITIES - 1), minlength=64 * PARITIES).astype(np.uint8) & 1).view(np.int64)
    fp = _signed(_majority(s.view(np.uint64)))
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, times[at], 0)))]
    return np.concatenate([[n, fp], odd, s[: _head_size(n)]])


def heads(text: Column, spark, common: list[tuple[int, int]]) -> Column:
    sent = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (zip(*sorted(common)) if common else ([], []))))

    @F.arrow_udf("array<bigint>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([head_of(t, *sent.value) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return made(text.cast("binary"))


def _frequent(shingles: DataFrame) -> dict[int, int]:
    """shingles: key. Those that more than COMMON rows have, with the number; MOST at most, the most common ones."""
    most = shingles.groupBy("key").agg(F.count("*").alias("times")).filter(F.col("times") > COMMON).orderBy(F.desc("times"), "key").limit(MOST)
    held = written(most, "near-common")
    found = {r.key: r.times for r in held.collect()}
    discard(held)
    return found


def common_shingles(text: Column, own: DataFrame) -> list[tuple[int, int]]:
    """Shingles that many texts have, with how many: those that are in many heads by hash alone, and all others of the texts whose heads have such.

    So what texts of a crowd share is known as a whole, and is put last in all of
    them. A text whose head has none keeps that head.
    """
    spark = own.sparkSession
    first = _frequent(own.select(F.explode(F.slice(heads(text, spark, []), BEFORE + 1, 1 << 30)).alias("key")))
    if not first:
        return []
    sent = spark.sparkContext.broadcast(np.array(sorted(first), np.int64))

    @F.arrow_udf("array<bigint>")
    def all_of_crowds(texts: pa.Array) -> pa.Array:
        each = (shingle_hashes(t) for t in texts.to_pylist())
        known = sent.value
        in_crowd = lambda s: len(s) and (known[np.minimum(np.searchsorted(known, h := s[: _head_size(len(s))]), len(known) - 1)] == h).any()
        return pa.array([s if in_crowd(s) else s[:0] for s in each], pa.list_(pa.int64()))

    return sorted((first | _frequent(own.select(F.explode(all_of_crowds(text.cast("binary"))).alias("key")))).items())


def _sizes_fit(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= FIFTHS * F.greatest(n, m)


def _largest(n: Column, pos: Column) -> Column:
    """The size of the largest text that can have four fifths in common with one of n shingles, if their heads first meet at this place of its: no more than what is left from there on is common."""
    return F.floor((FIFTHS + 5) * (n - pos) / FIFTHS) - n


def _cell(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(CELL))).cast("int")


def _alike(x, y) -> Column:
    """Whether texts of these parities can have four fifths in common: each place that differs is a shingle that only one of them has, and of such a ninth of both sizes is allowed."""
    differ = F.lit(0)
    for k in range(PARITIES):
        differ = differ + F.bit_count(x[f"p{k}"].bitwiseXOR(y[f"p{k}"]))
    return (FIFTHS + 5) * differ <= (5 - FIFTHS) * (x["n"] + y["n"])


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def pivot_pairs(points: DataFrame) -> DataFrame:
    """points: t, fp. Pairs a < b of texts that the pivot tables link: those of equal fingerprints with the least of them, and these as their fingerprints are linked."""
    one = written(points.groupBy("fp").agg(F.min("t").alias("one")), "near-prints")  # written, so that Spark can split what a common one is joined with
    same = points.join(one, "fp").filter("t <> one").select(*_pair("t", "one"))
    links = near_pairs(one.select(F.lit(0).alias("family"), "fp"))
    ends = links.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")
    out = same.unionByName(ends.select(*_pair("x", "y")))
    out._tessera_uses = (links._tessera_uses, one)
    return out


def similar(points: DataFrame, texts: DataFrame) -> DataFrame:
    """points: t, head, one row for each t. texts: t, text. Links a < b of texts that are near copies; they connect all that are, without all pairs of a crowd.

    First come the pairs that the pivot tables link, and for each shingle that is in
    several heads the pairs of one text with all others: the one that is in most such
    crowds, which has least of its own. Then all are compared that share a shingle of
    their heads but are not connected yet: those that are not in the crowd's largest
    component with all of the others, but for pairs whose sizes, places or parities
    are too far apart.
    """
    spark = points.sparkSession
    at = lambda k: F.element_at("head", k)
    parities = points.select("t", at(1).cast("int").alias("n"), *[at(k + 3).alias(f"p{k}") for k in range(PARITIES)])
    members = points.select("t", at(1).cast("int").alias("n"), F.posexplode(F.slice("head", BEFORE + 1, F.size("head"))).alias("pos", "key"))
    times = members.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    rows = written(members.join(times, "key"), "near-keys")
    often = rows.groupBy("t").agg(F.count("*").alias("crowds"))
    hubs = written(rows.select("key", "t").join(often, "t").groupBy("key").agg(F.max_by("t", F.struct("crowds", "t")).alias("hub")), "near-hubs")
    met = rows.join(hubs, "key").filter("t <> hub").select(*_pair("t", "hub"))
    near = pivot_pairs(points.select("t", at(2).alias("fp")))
    first = written(_plausible(met.unionByName(near).distinct(), parities), "near-candidates")
    discard(*near._tessera_uses)
    links = written(verified(first, texts), "near-links")
    discard(first)
    roots = components(links)
    crowd = rows.filter("times > 2").join(roots.withColumnRenamed("v", "t"), "t", "left").select("key", "t", "n", "pos", F.coalesce("root", "t").alias("root"))
    crowd = written(crowd, "near-crowds")
    most = crowd.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    most = written(most.select("key", "most"), "near-most")
    left = written(crowd.join(most, "key").join(parities.drop("n"), "t"), "near-crowds")
    discard(rows, hubs, crowd, most)
    rest = _not_yet_connected(left, parities.columns[1:])
    rest = written(rest.distinct(), "near-candidates")
    discard(left)
    return links.unionByName(verified(rest, texts))


def _not_yet_connected(rows: DataFrame, kept: list[str]) -> DataFrame:
    """rows: key, t, n, pos, root, most, parities. Pairs a < b of one key that can reach four fifths and are not connected, nor both in the key's largest component.

    The larger text of a pair looks for the smaller one in the cells of the sizes that it may
    have, by the places of both; so texts that none of these sizes fits don't meet at all.
    """
    limit = _largest(F.col("n"), F.col("pos"))
    sized = rows.withColumn("limit", limit)
    low, high = F.ceil(FIFTHS * F.col("n") / 5), F.least("n", "limit")
    larger = sized.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("cell", F.explode(F.sequence(_cell(F.col("low")), _cell(F.col("high"))))).alias("x")
    smaller = sized.filter("n <= limit and n > 0").withColumn("cell", _cell(F.col("n"))).alias("y")
    of = lambda name: {c: F.col(f"{name}.{c}") for c in kept}
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.root") != F.col("y.root"))
    fits = F.col("y.n").between(F.col("x.low"), F.col("x.high")) & (F.col("x.n") <= F.col("y.limit")) & ((F.col("x.n") > F.col("y.n")) | (F.col("x.t") > F.col("y.t")))
    on = same & fits & _alike(of("x"), of("y"))
    apart, rest = "root <> most", "root = most"
    made = larger.filter(apart).join(smaller, on).select(*_pair("x.t", "y.t"))
    return made.unionByName(larger.filter(rest).join(smaller.filter(apart), on).select(*_pair("x.t", "y.t")))


def _plausible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs whose sizes and parities do not rule them out."""
    both = pairs.join(parities.withColumnRenamed("t", "a").alias("x"), "a").join(parities.withColumnRenamed("t", "b").alias("y"), "b")
    of = lambda name: {c: F.col(f"{name}.{c}") for c in parities.columns[1:]}
    return both.filter(_sizes_fit(F.col("x.n"), F.col("y.n")) & _alike(of("x"), of("y"))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: a, b. texts: t, text, equal for equal t. The pairs of which four fifths of the five-word shingles that either has are common."""

    @F.arrow_udf("array<bigint>")
    def shingles(column: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t) for t in column.to_pylist()], pa.list_(pa.int64()))

    ends = sent_if_small(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "simhash-ends")
    once = texts.join(ends, "t", "left_semi").dropDuplicates(["t"])
    sets = written(once.select("t", shingles(F.col("text").cast("binary")).alias("s")), "simhash-sets")
    left = pairs.join(sets.toDF("a", "sa"), "a")
    both = left.join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter((FIFTHS + 5) * common >= FIFTHS * (F.size("sa") + F.size("sb"))).select("a", "b")


def one_of_each_group(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with one row of each group of near copies, that of the smallest key.

    Texts are linked if four fifths of the five-word shingles that either has are common,
    and groups are what links connect; no such pair is left out. Equal texts are one
    group from the start. Of rows with equal smallest keys, those of equal text are one
    row and the first by text stays; null keys come last. Null texts count as empty
    ones. An empty table gives an empty one. All columns stay.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = take(df, key, text).toDF("key", "text").withColumn("text", F.coalesce("text", F.lit("")))
    same = own.select("key", "text", F.xxhash64("text").alias("t"))
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.sha2("text", 256).alias("sha"))
    common = common_shingles(own["text"], own)
    docs = written(same.select(rank.alias("rank"), "t"), "near-docs")
    points = written(same.select("t", heads(same["text"], spark, common).alias("head")).groupBy("t").agg(F.first("head").alias("head")), "near-points")
    links = written(similar(points, same.select("t", "text")), "near-links")
    discard(points)
    roots = components(links)
    grouped = docs.select("rank", "t").join(roots.withColumnRenamed("v", "t"), "t", "left").select("rank", F.coalesce("root", "t").alias("root"))
    first = grouped.groupBy("root").agg(F.min("rank").alias("rank")).select("rank").distinct()
    return _only(df, key, text, first)


def _only(df: DataFrame, key: str, text: str, first: DataFrame) -> DataFrame:
    """The rows of df that are first, one for each; rows equal in key and text are told apart by all columns."""
    wide, at = plain(df, key, text)
    names = wide.columns
    k, t = map(F.col, at)
    sha = F.sha2(F.coalesce(t, F.lit("")), 256)
    there = first.select(F.coalesce(F.col("rank.key").cast("string"), F.lit("")).alias("at"), F.col("rank.none").alias("none"), F.col("rank.sha").alias("sha"))
    kept = wide.withColumn("at", F.coalesce(k.cast("string"), F.lit(""))).withColumn("none", k.isNull()).withColumn("sha", sha).join(there, ["at", "none", "sha"], "left_semi")
    return kept.dropDuplicates(["at", "none", "sha"]).select(*names).toDF(*df.columns)
