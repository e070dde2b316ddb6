import hashlib
import random
import zlib

import pytest

from tessera.llm import runs as own
from tessera.llm.queries import op11_runs


def slow(words, least=12):
    """All runs by comparing the words at each distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            w = words[s:e]
            if j > i and e - s >= max(least, 2 * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_against_all_distances(seed):
    rng = random.Random(seed)
    for _ in range(1200):
        n, k, least = rng.randint(0, 140), rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([12, 12, 12, 2, 4, 20])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a = rng.randrange(n)
            e, p = rng.randint(a, n), 1 + rng.randrange(max(1, (n - a) // 2))
            words[a:e] = [words[a + i % p] for i in range(e - a)]
        assert own.runs(words, least) == slow(words, least), (words, least)


def test_words_of_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert own.runs(b) == slow(b)
    for w in ([0] * 200, [0, 1] * 100 + [0, 0, 1] * 60, [0] * 70 + [1] + [0] * 129, ([0] * 31 + [1]) * 9, [k % 50 for k in range(210)] + [k % 51 for k in range(190)]):
        assert own.runs(w) == slow(w)


def test_long_texts_take_near_linear_time():
    n = 150_000
    assert own.runs([0] * n) == [(0, n, 1)]
    assert own.runs([k % 40_000 for k in range(n)]) == [(0, n, 40_000)]
    assert own.runs([0] * 60_000 + [1] + [0] * 89_999) == [(0, 60_000, 1), (60_001, 89_999, 1)]
    assert own.runs(list(range(n))) == []


def test_every_period_has_a_block():
    for least in (2, 12, 30):
        seen = [(q, size) for size, low, high in own.bands(3000, least) for q in range(low, high + 1)]
        assert [q for q, _ in seen] == list(range(1, 3001))
        assert all(2 * size - 1 <= max(least - q, q) for q, size in seen)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = None if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    stay = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(stay).hexdigest())


def test_query_against_all_distances(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, None, "x", 1), (7, "", "x", 1), (8, " \t\n\x0b ", "x", 1), (9, "a b c", "x", 1), (9, "a b c", "x", 1), (10, "same words here " * 300, "x", 1), (None, "a b " * 20, "x", 1)]
    rows += [(k, "".join(rng.choice("abcdefé") + rng.choice(" \n  ") for _ in range(rng.randint(0, 300))), "x", 1) for k in range(11, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, TEXT_ int").withColumnRenamed("TEXT_", "n_runs")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10
    assert own.digest(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, Text int")
    assert own.digest(clash).first().n_runs == 0


def test_runs_as_columns_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go " * 20 + "on"), (2, None), (3, "x y")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in own.periodic(df).collect()}
    assert got == {1: [(0, 20, 1)], 2: [], 3: []}
    assert {r.doc_id: r.text for r in own.collapsed(df).collect()} == {1: "go on", 2: None, 3: "x y"}
