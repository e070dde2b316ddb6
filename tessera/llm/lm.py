"""Operator 5: language-model scores by stupid backoff, computed relationally.

N-grams of one word up to `order` are counted over all documents, each under its
64-bit hash, with no vocabulary and no cutoff. A document is scored by the counts
of all others: its own are left out, so that it does not vouch for itself. A word
scores the relative count of the longest n-gram ending in it that occurs
elsewhere, times BACKOFF for each longer one that does not.

Three relations, nested so that a row is not one n-gram but many:

grams   block, part, grams   the n-grams that each block of documents explodes
                             into, once each with their number, in their order
                             as hashes; part is a range of all hashes
counts  block, part, counts  grams joined with the count table of its part: in
                             place of each n-gram its count in all blocks
scores                       counts joined with the block's texts, and the log
                             scores of words summed per document

A block is some BLOCK_BYTES of text, so the most common n-gram has a number for
each block, not for each occurrence, and all parts are alike in size. There are as
many parts as keep the numbers in one at some PART_GRAMS, by the bytes of all texts.
Nothing else of the corpus is held anywhere, and nothing but its number of words
and bytes reaches the driver.

A block is found again by its place in the scan. Both scans run before scores returns,
with the settings that files are split by held fixed, so neither settings nor executors
that change meanwhile move a block; a table that is not read from files is
written first. A block whose counts are not as many as its n-grams is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD, discard, small_batches, take, written

ORDER = 3
BACKOFF = 0.4
#: A block ends with the text that brings it to so many bytes; it bounds what a task holds, not what is counted.
BLOCK_BYTES = 6 << 20
#: What a row counts as besides its text, so that blocks of empty texts end too.
ROW_BYTES = 64
#: N-grams in a part, by an estimate of a word in each WORD_BYTES.
PART_GRAMS, WORD_BYTES = 1 << 20, 6


@contextmanager
def fixed_splits(spark) -> Iterator[None]:
    """Files are split alike by all that is run inside, however many cores there are at the time; the settings are restored."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    held = [spark.conf.get(n) for n in names[:2]]
    tasks = before[names[2]] or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    try:
        for name, value in zip(names, (*held, str(tasks)), strict=True):
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def blocks(batches, most: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks that end with the row that brings them to so many bytes, numbered by partition and place. The first column is the text, in bytes."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        start, before = 0, 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, before + most - size)) + 1, len(ends))
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size >= most:
                yield number, pa.Table.from_batches(held)
                held, size, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; the text of each word; and for each order the places of the words in which its n-grams end, with their hashes."""
    of = xxhash.xxh64_intdigest
    each = [np.fromiter(map(of, (t or b"").split()), np.uint64) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    words = np.concatenate(each) if each else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(each)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, last = [], np.zeros(len(words), np.uint64)
    for k in range(order):
        before = np.concatenate([last[:1], last[:-1]])
        last = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k + 1)) if k else _mixed(words + np.uint64(1))
        ends = np.flatnonzero(place >= k)
        grams.append((ends, last[ends]))
    return sizes, doc, grams


def pack(numbers: np.ndarray) -> bytes:
    """Integers byte by byte of equal rank, compressed; the upper ones of small numbers come to nothing."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def parted(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For hashes that are in order, the parts that have any, and where each of them begins, with the end of the last one."""
    part = (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    begin = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    return part[begin].astype(np.int32), np.append(begin, len(grams))


def exploded(own: DataFrame, parts: int, order: int, most: int) -> DataFrame:
    """own: text as binary, first. block, part, grams (steps between hashes), n."""

    def rows(batches):
        for number, table in blocks(batches, most):
            grams, n = np.unique(np.concatenate([g for _, g in ngrams(table.column(0).to_pylist(), order)[2]]), return_counts=True)
            part, at = parted(grams, parts)
            for k in range(0, len(part), 64):
                each = [slice(*x) for x in zip(at[k : k + 64], at[k + 1 : k + 65])]
                packed = [pack(np.diff(grams[x], prepend=np.uint64(0))) for x in each]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(each), pa.int64()), pa.array(part[k : k + 64]), pa.array(packed, pa.binary()), pa.array([pack(n[x]) for x in each], pa.binary())], ["block", "part", "grams", "n"])

    return own.select("text").mapInArrow(rows, "block long, part int, grams binary, n binary")


def counted(grams: DataFrame) -> DataFrame:
    """block, part, counts: of each n-gram of the block the count in all blocks."""

    def joined(table: pa.Table) -> pa.Table:
        each = [np.cumsum(unpack(g), dtype=np.uint64) for g in table["grams"].to_pylist()]
        n = np.concatenate([unpack(x) for x in table["n"].to_pylist()])
        _, which = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(which, weights=n).astype(np.int64)[which]  # exact up to 2 ** 53
        ends = np.cumsum([len(x) for x in each])
        return pa.table({"block": table["block"], "part": table["part"], "counts": pa.array([pack(t) for t in np.split(total, ends[:-1])], pa.binary())})

    return grams.groupBy("part").applyInArrow(joined, "block long, part int, counts binary")


def _log_scores(sizes: np.ndarray, doc: np.ndarray, grams: list, counts: np.ndarray, total: int) -> np.ndarray:
    """The sum of the log scores of each text's words. counts: those in all texts of the distinct n-grams, in their order as hashes."""
    every = np.concatenate([g for _, g in grams])
    whose = np.concatenate([doc[ends] for ends, _ in grams]).astype(np.uint64)
    distinct, which = np.unique(every, return_inverse=True)
    if len(distinct) != len(counts):
        raise ValueError(f"a block of {len(distinct)} n-grams has {len(counts)} counts: it was not read as it was counted")
    _, mine, times = np.unique(_mixed(every + whose * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    rest = counts[which].astype(np.int64) - times[mine]
    out, lower, begin = np.zeros(len(doc)), np.zeros(0, np.int64), 0
    for k, (ends, _) in enumerate(grams):
        n = np.zeros(len(doc), np.int64)
        n[ends] = rest[begin : begin + len(ends)]
        begin += len(ends)
        if k:
            out[ends] += math.log10(BACKOFF)
            seen = np.flatnonzero(n)
            out[seen] = np.log10(n[seen] / lower[seen - 1])
        else:
            out = np.log10(np.maximum(n, 1) / np.maximum(total - sizes[doc], 1))
        lower = n
    return np.bincount(doc, weights=out, minlength=len(sizes)).astype(np.float64)  # of no words it would be integers


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of df: the key, n_words, log_score (base 10, of the whole text) and log_per_word, rounded to 4 places.

    Counts are those of all other rows, repeated ones included. A word that no other
    row has counts once; so does the number of words, where no other row has any.
    Null and empty texts have no words, score 0, and null per word; repeated rows
    give repeated rows, and vouch for each other; a null key stays null; an empty
    table gives an empty one; other columns are dropped. Bytes that are not valid
    UTF-8 are part of words like any other.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = take(df, key, text).toDF("key", "text")
    if "FileScan" not in (plan := own._jdf.queryExecution().sparkPlan().toString()) or any(x in plan for x in ("Join", "Aggregate", "Exchange", "Sort", "Limit", "Union")):
        own = written(own, "lm-texts")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    total, size = own.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    own = own.select(F.col("text").cast("binary").alias("text"), "key")
    parts, most = 1 + order * size // (WORD_BYTES * PART_GRAMS), BLOCK_BYTES
    def placed(batches):
        for number, rows in blocks(batches, most):
            for b in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), number)), b.column(0), b.column(1)], ["block", "text", "key"])

    kind = own.schema["key"].dataType.simpleString()

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        sizes, doc, grams = ngrams(texts["text"].to_pylist(), order)
        held = counts.sort_by("part")["counts"].to_pylist()
        sums = _log_scores(sizes, doc, grams, np.concatenate([unpack(c) for c in held] or [np.zeros(0, np.uint64)]), total)
        return pa.table({"key": texts["key"], "size": sizes, "sum": sums})

    texts = own.mapInArrow(placed, f"block long, text binary, key {kind}")
    with fixed_splits(spark):
        counts = written(counted(exploded(own, parts, order, most)), "lm-counts")
        out = written(texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(scored, f"key {kind}, size long, sum double"), "lm-scores")
    discard(counts)
    return out.select(F.col("key").alias(key), F.col("size").alias("n_words"), F.round("sum", 4).alias("log_score"), F.when(F.col("size") > 0, F.round(F.col("sum") / F.col("size"), 4)).alias("log_per_word"))
