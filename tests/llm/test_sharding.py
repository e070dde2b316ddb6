import random
import zlib
from collections import Counter, defaultdict

from tessera.llm import sharding


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, SHARD int")


def check(spark, texts, tolerance=0.02):
    got = sharding.digest(frame(spark, texts).repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share, most = sum(size.values()) / 16, max((len((t or "").encode()) + 1 for t in texts), default=0)
    assert all(0 <= s < 16 for s in size)
    assert all(abs(size[s] - share) <= 2 * (0.001 * share + most) for s in range(16))
    again = sharding.digest(frame(spark, texts).repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    return got


def test_hot_group_and_long_texts(spark):
    rng = random.Random(8)
    texts = ["the same copy"] * 1500 + ["".join(rng.choices("abcé ", k=rng.randint(0, 50))) for _ in range(2000)] + ["x" * 3000, None, "", None]
    got = check(spark, texts)
    shards = {r.shard for r in got if r.doc_id < 1500}
    assert shards == set(range(min(shards), max(shards) + 1))  # equal texts lie together


def test_few_rows(spark):
    for texts in ([], ["a"], ["a", "b"], ["same"] * 3, ["long " * 1000, "b"]):
        got = sharding.digest(frame(spark, texts)).collect()
        assert len(got) == len(texts)


def test_repeated_rows_stay_together(spark):
    df = spark.createDataFrame([(None, "t")] * 50, "doc_id long, text string")
    got = sharding.digest(df).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(50))


def slow_placement(rows, bounds, cuts):
    """Where a plain sort by key, then by the other columns, puts each row, between the cuts that the operator chose."""
    out, begins = {}, [bounds[c] for c in cuts]
    last, slot = 0, 0
    for key, rest in sorted(rows):
        shard = sum(key >= b for b in begins)
        slot = slot + 1 if shard == last and out else 0
        last = shard
        out[key, rest] = (shard, slot)
    return out


def test_placement_against_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 40)
    rng = random.Random(21)
    texts = ["a copy"] * 700 + ["".join(rng.choices("abcé ", k=rng.randint(0, 80))) for _ in range(1500)] + ["y" * 5000]
    df = frame(spark, texts)
    keys = {r.doc_id: (r.k, r.s) for r in df.select("doc_id", sharding.sort_key(df["text"], df["doc_id"]).alias("k"), sharding.F.octet_length("text").alias("s")).collect()}
    rows = df.select(df["doc_id"].alias("key"), (sharding.F.octet_length("text") + 1).cast("long").alias("size"), sharding.sort_key(df["text"], df["doc_id"]).alias("sort_key"))
    bounds, sizes, counts, cuts = sharding.splitters(rows, 16, 0.001)
    ordered = sorted((k, s + 1) for k, s in keys.values())
    for b, size, count in zip(bounds, sizes, counts, strict=True):
        below = [s for k, s in ordered if k < b or b == sharding.HIGH]
        assert (sum(below), len(below)) == (size, count)
    want = slow_placement([(keys[i][0], (i, keys[i][1] + 1)) for i in keys], bounds, cuts)
    got = {r.key: (r.shard, r.slot) for r in sharding.shard(rows, 16, 0.001).collect()}
    assert got == {i: place for (_, (i, _)), place in want.items()}
    held = [counts[k + 1] - counts[k] for k in range(len(bounds) - 1)]
    assert max(held) <= 40
