"""Operator 3: mixing sources to target weights.

Each document draws an exponential key scaled by its quality weight, -ln(u) / w,
as Efraimidis and Spirakis do; u comes from the MD5 of its id and its text, so reruns agree. A
source whose target is above its size gives complete epochs first; the rest of
its token budget goes to the documents with the smallest keys, as far as the
prefix sum of their sizes reaches.

No source is ever sorted whole, as one may hold a third of all rows. Keys fall
into BINS ordered bins; sizes are summed by source and bin, and only the one bin
of each source in which the budget ends is sorted and prefix-summed document by
document. All other bins are in or out as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import SPACES, SYMBOL_CLASS, plain, take, word_count, written

BINS = 4096
#: Sources whose plan is small enough to send to all executors; more are joined by key.
FEW_SOURCES = 20_000
SEED = "mix-1"


def _times(text: Column, characters: str) -> Column:
    """How often a text has ASCII characters: by the bytes it is shorter without them, which is less work than a pattern."""
    without = text
    for c in characters:
        without = F.replace(without, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(without)


def quality_weight(text: Column, size: Column) -> Column:
    """From 1 to 4: a point each for 50 words or more, for words of 3 to 12 characters on average, and for at most one symbol in ten words."""
    text = F.coalesce(text, F.lit(""))
    chars, symbols = F.char_length(text) - _times(text, SPACES), _times(text, SYMBOL_CLASS[1:-1])
    return (F.lit(1) + (size >= 50).cast("int") + ((chars >= 3 * size) & (chars <= 12 * size)).cast("int") + (10 * symbols <= size).cast("int")).cast("long")


def draw(key: Column, text_md5: Column, weight: Column, seed: str = SEED) -> Column:
    """The exponential key of a document by its id (null counts as a text of its own) and the MD5 of its text, so that documents of one id do not draw alike."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), text_md5)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _bin(drawn: Column) -> Column:
    return F.least(F.floor(BINS * (1 - F.exp(-drawn))), F.lit(BINS - 1)).cast("int")


def _own(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2) -> DataFrame:
    """sizes: source, source_size. Adds `target`.

    Sources by code point, null last, have the weights in turn and share so much
    of all words; a target stops at cap times its source's size, and what is above
    is shared again by weight. In order of size to weight, a source is at its cap
    if the share left to it and its successors would give it more.
    """
    over, under = share
    in_order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1).cast("long")
    by_need = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    out = sizes.withColumn("w", weight).withColumn("all", F.sum("source_size").over(W.partitionBy()))
    out = out.withColumn("before", F.coalesce(F.sum("source_size").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("left", F.sum("w").over(by_need.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("capped", cap * under * F.col("source_size") * F.col("left") <= F.col("w") * (over * F.col("all") - cap * under * F.col("before")))
    free = W.partitionBy()
    out = out.withColumn("rest", over * F.col("all") - cap * under * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(free), F.lit(0)))
    out = out.withColumn("open", F.sum(F.when(~F.col("capped"), F.col("w"))).over(free))
    share_of = (F.col("w") * F.col("rest")).cast("double") / (under * F.col("open")).cast("double")
    return out.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share_of).alias("target"))


def plan(rows: DataFrame, **shares) -> DataFrame:
    """rows: key, md5, source, size, weight. For each source its target, whole epochs, the budget left after them, the bin in which that ends, and the words in the bins before."""
    rows = rows.withColumn("own", _own(F.col("source"))).withColumn("bin", _bin(draw(F.col("key"), F.col("md5"), F.col("weight"))))
    bins = written(rows.groupBy("own", "source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    aims = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("own", _own(F.col("source"))).withColumnRenamed("source", "named")
    before = F.coalesce(F.sum("words").over(W.partitionBy("own").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = bins.withColumn("before", before).join(aims.select("own", "budget"), "own").filter("before <= budget and budget < before + words")
    edge = edge.select("own", F.col("bin").alias("edge"), "before")
    # a source without an edge takes no fraction (budget 0 in bins without words) or all of it
    return aims.join(edge, "own", "left").select("own", "source_size", "target", "epochs", "budget", F.coalesce("edge", F.when(F.col("budget") > 0, BINS).otherwise(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))


def mix(df: DataFrame, planned: DataFrame, key: str, md5: str, source: str, size: str, weight: str, whole: bool = False) -> DataFrame:
    """df with source_size, target, and `taken`: the words of each row that the mix takes, repeats counted.

    Of a source's fraction, the row at which the budget ends gives as many words as
    are left; with whole, it is taken whole if at least half of it fits, and not
    at all otherwise, so a source misses its target by half a document at most.
    Rows with equal draws go by key, then size: those that are equal in id and text,
    which alone share a bin whatever their number.
    """
    planned = written(planned, "mix-plan")
    if planned.count() <= FEW_SOURCES:
        planned = F.broadcast(planned)
    rows = df.withColumn("__own", _own(F.col(source))).join(planned.withColumnRenamed("own", "__own"), "__own")
    rows = rows.withColumn("__drawn", draw(F.col(key), F.col(md5), F.col(weight)))
    clear = rows.filter(_bin(F.col("__drawn")) != F.col("edge"))
    at_edge = rows.filter(_bin(F.col("__drawn")) == F.col("edge"))
    in_order = W.partitionBy("__own").orderBy("__drawn", key, size).rowsBetween(W.unboundedPreceding, -1)
    room = F.col("budget") - F.col("before") - F.coalesce(F.sum(size).over(in_order), F.lit(0))
    part = F.when(2 * room >= F.col(size), F.col(size)).otherwise(0) if whole else F.least(F.greatest(room, F.lit(0)), F.col(size))
    clear = clear.withColumn("__part", F.when(_bin(F.col("__drawn")) < F.col("edge"), F.col(size)).otherwise(0))
    both = clear.unionByName(at_edge.withColumn("__part", part))
    return both.select(*df.columns, "source_size", "target", (F.col("epochs") * F.col(size) + F.col("__part")).cast("long").alias("taken"))


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    own = take(df, key, source, text).toDF("key", "source", "text").withColumn("size", word_count(F.col("text")))
    return own.select("key", "source", "size", quality_weight(F.col("text"), F.col("size")).alias("weight"), _md5(F.col("text")).alias("md5"))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of df: the key, its size in words, its source's size and target, and the words taken.

    Null and empty texts have size 0 and give no words; documents of null source are
    a source of their own; repeated rows share their draw, and the edge of a budget
    may fall between them; an empty table gives an empty one; other columns are dropped.
    """
    rows = written(_rows(df, key, text, source), "mix-rows")
    out = mix(rows, plan(rows), "key", "md5", "source", "size", "weight")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows as the mix repeats them, whole documents only, with df's columns.

    Texts without words, null ones too, are in no mix. Repeated rows are repeated
    each; null sources and keys are as in digest; an empty table gives an empty one.
    """
    rows = written(_rows(df, key, text, source), "mix-rows")
    wide, (k, t, s) = plain(df, key, text, source)
    names = wide.columns
    wide = wide.withColumn("__size", word_count(F.col(t)))
    wide = wide.withColumn("__weight", quality_weight(F.col(t), F.col("__size")))
    wide = wide.withColumn("__md5", _md5(F.col(t)))
    out = mix(wide, plan(rows), k, "__md5", s, "__size", "__weight", whole=True)
    times = F.when(F.col("__size") > 0, (F.col("taken") / F.col("__size")).cast("int")).otherwise(0)
    out = out.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*names).toDF(*df.columns)
