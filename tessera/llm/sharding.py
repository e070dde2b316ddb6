"""Operator 4: shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: the upper half hashes the text, so that equal
texts lie together, the lower half hashes the id, so that a large group of them
can still be cut. Candidate boundaries are spread over the key range, and the
exact bytes and rows below each are counted across all partitions in one pass.
Cells that hold a wanted splitter, or too many rows for one task, are probed
again more finely, until every splitter meets its tolerance. Only then are rows
exchanged, once, by ranges of cells; slots follow from the counts and the rank
inside a range.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import take, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Boundaries of the first pass, and new ones in each cell that is probed again.
FIRST, FINER = 1024, 256
#: A cell with more than one of CELLS of all rows, or more than CELL_ROWS, is probed again, so that no task gets more.
CELLS, CELL_ROWS = 512, 2_000_000


def sort_key(text, key):
    upper = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(~0xFFFFFFFF))
    return upper.bitwiseOR(F.xxhash64(key.cast("string")).bitwiseAND(F.lit(0xFFFFFFFF)))


def count_below(rows: DataFrame, bounds: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with keys below each bound. Each task sends one row per cell that it has rows in."""
    held = rows.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    def cells(batches):
        edges = held.value
        size, count = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            np.add.at(count, at, 1)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(count[full])], ["cell", "bytes", "n"])

    found = rows.select("sort_key", "size").mapInArrow(cells, "cell long, bytes long, n long").groupBy("cell").agg(F.sum("bytes"), F.sum("n")).collect()
    size, count = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for cell, b, n in found:
        size[cell], count[cell] = b, n
    return np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist()


def most_rows(n: int) -> int:
    """The rows of a cell, of n in all."""
    return min(max(1, n // CELLS), CELL_ROWS)


def splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[int], list[int], list[int], list[int]]:
    """Boundaries with the exact bytes and rows below them, and which of them part the shards.

    Refining ends where each wanted splitter has a boundary within tolerance times
    a shard's share, or sits in a cell of one row or one key, and no cell of more
    than one key has more rows than a task should get.
    """
    total, n = (x or 0 for x in rows.agg(F.sum("size"), F.count("*")).first())
    share = total / shards
    step = (1 << 64) // FIRST
    below = {LOW: (0, 0), HIGH: (total, n)}
    new = [LOW + k * step for k in range(1, FIRST)]
    while new and n:
        below |= dict(zip(new, zip(*count_below(rows, new), strict=True), strict=True))
        bounds = sorted(below)
        split = set()
        for k in range(len(bounds) - 1):
            held = below[bounds[k + 1]][1] - below[bounds[k]][1]
            if held > most_rows(n):
                split.add(k)
        for s in range(1, shards):
            want = s * share
            k = bisect.bisect_right([below[b][0] for b in bounds], want) - 1
            k = min(k, len(bounds) - 2)
            near = min(abs(below[b][0] - want) for b in bounds[k : k + 2])
            if near > tolerance * share and below[bounds[k + 1]][1] - below[bounds[k]][1] > 1:
                split.add(k)
        new = []
        for k in split:
            low, high = bounds[k], bounds[k + 1]
            pieces = min(FINER, high - low)
            new += [low + (high - low) * j // pieces for j in range(1, pieces)]
        new.sort()
    bounds = sorted(below)
    sizes = [below[b][0] for b in bounds]
    cuts = [min(range(len(bounds)), key=lambda i: (abs(sizes[i] - s * share), i)) for s in range(1, shards)]
    return bounds, sizes, [below[b][1] for b in bounds], sorted(cuts)


def shard(rows: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """rows, with columns sort_key and size, and `shard` (from 0) and `slot` (from 0 in each shard, without gaps) added.

    Rows of one key stay in one shard. The same rows give the same shards however
    they are partitioned; rows that are equal in all columns may change places.
    """
    bounds, _, counts, cuts = splitters(rows, shards, tolerance)
    n = counts[-1]
    # ranges of cells for the exchange: they end at each cut, and where enough rows are together
    starts, range_shard, range_slot, shard_start, s = [], [], [], 0, 0
    for k in range(len(bounds) - 1):
        fresh = False
        while s < len(cuts) and cuts[s] <= k:
            s, fresh, shard_start = s + 1, True, counts[k]
        if not starts or fresh or counts[k + 1] - counts[starts[-1]] > most_rows(n):
            starts.append(k)
            range_shard.append(s)
            range_slot.append(counts[k] - shard_start)
    held = rows.sparkSession.sparkContext.broadcast((np.array([bounds[k] for k in starts[1:]], np.int64), np.array(range_shard, np.int32), np.array(range_slot, np.int64)))
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    at_key = rows.columns.index("sort_key")

    def placed(batches):
        edges, of_shard, first = held.value
        for b in batches:
            at = np.searchsorted(edges, b.column(at_key).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(of_shard[at]), pa.array(first[at])], schema.names)

    out = rows.mapInArrow(placed, schema)
    rank = F.row_number().over(W.partitionBy("part").orderBy("sort_key", *[c for c in rows.columns if c != "sort_key"])) - 1
    return out.withColumn("slot", F.col("slot") + rank).drop("part", "sort_key")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """One row per row of df: the key, its bytes plus one, the CRC-32 of its text, and its shard and slot.

    Null texts count as empty ones. Rows equal in key and text stay together, so a
    table of one row repeated goes to one shard; a null key is hashed as such; an
    empty table gives an empty one; other columns are dropped.
    """
    own = take(df, key, text).toDF("key", "text")
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = written(own.select("key", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), sort_key(F.col("text"), F.col("key")).alias("sort_key")), "shard-rows")
    out = shard(rows, shards, tolerance)
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
