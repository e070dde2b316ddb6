import hashlib
import math
import random
import re
from collections import defaultdict

from tessera.llm import mixing
from tessera.llm.base import WORD


def rows(n=800):
    rng = random.Random(7)
    names = ["b", "a", None, "é", "Z", "tiny", "none"]
    out = []
    for i in range(n):
        source = rng.choices(names, [30, 8, 5, 5, 3, 1, 1])[0]
        words = 0 if source == "none" else rng.choice([0, 1, 5, 60, 300])
        out.append((i, None if words == 0 and i % 2 else " ".join(rng.choice(["w#", "word", "x"]) for _ in range(words)), source, "k"))
    return [*out, *out[:40], (None, "no id", "b", "k")]


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > 2 * sizes[s]]
        if not above:
            return fixed | target
        fixed |= {s: 2 * sizes[s] for s in above}


def slow(docs):
    sized = [(i, len(re.findall(WORD, t or "")), t or "", s) for i, t, s, _ in docs]
    sizes = defaultdict(int)
    for _, n, _, s in sized:
        sizes[s] += n
    target = water(sizes)
    out = []
    for s in sizes:
        def drawn(r):
            i, n, t, _ = r
            chars = len(re.sub(r"[\x20\x09-\x0D]", "", t))
            w = 1 + (n >= 50) + (3 * n <= chars <= 12 * n) + (10 * len(re.findall(r"[#*$%&|<>]", t)) <= n)
            u = (int(hashlib.md5(f"mix-1:{'null' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / w, -1 if i is None else i, n)
        own = sorted((r for r in sized if r[3] == s), key=drawn)
        epochs = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        room = round(target[s] - epochs * sizes[s])
        for i, n, _, _ in own:
            part = min(n, max(room, 0))
            room -= n
            out.append((i, n, sizes[s], round(target[s], 6), epochs * n + part))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, TAKEN string").repartition(5)
    got = sorted(((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, mixing.digest(df).collect())), key=str)
    assert got == slow(docs)
    by = defaultdict(int)
    for r in mixing.digest(df).collect():
        assert r.taken <= 2 * r["size"]
        by[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())


def test_documents_of_one_id_do_not_share_a_bin(spark):
    df = spark.createDataFrame([(None, f"word {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    made = mixing._rows(df, "doc_id", "text", "source")
    drawn = made.select(mixing._bin(mixing.draw(made["key"], made["md5"], made["weight"])).alias("bin")).groupBy("bin").count()
    assert max(r["count"] for r in drawn.collect()) < 20


def test_ties_at_the_edge_of_a_budget(spark):
    rows = [(7, "five words are in here", "s")] * 9 + [(8, "one", "s")] + [(9, "x " * 200_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [tuple(r) for r in mixing.digest(df).collect()]
    assert sorted(got, key=str) == slow([(i, t, s, 0) for i, t, s in rows])


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.digest(df).count() == 0 and mixing.repeated(df).count() == 0
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.digest(df).collect()] == [(1, 0, 0, 0.0, 0)]


def test_repeated_documents(spark):
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, TAKEN string")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    got, sizes = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    for _, t, s, _ in docs:
        sizes[s] += len((t or "").split())
    for s, target in water(sizes).items():
        assert abs(got[s] - target) <= 150
