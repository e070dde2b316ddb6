import random
from collections import Counter

import numpy as np

from tessera.llm import quality


def slow(text, limits=quality.Limits()):
    text = text or ""
    words = [w for w in "".join(" " if c in quality.SPACES else c for c in text).split(" ") if w]

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if any(c not in quality.SPACES for c in x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, words))
    symbols = sum(c in quality.SYMBOLS for c in text)
    failed = len(words) < 50 or 100 * len(inside(3)) > 50 * len(words)
    bad = failed or any(100 * sum(len(words[j]) for j in inside(n)) > most * chars for n, most in limits.ngrams)
    bad = bad or 100 * sum(map(len, dup)) > limits.line_chars * sum(map(len, lines)) or 100 * symbols > limits.symbols * len(words)
    return (len(words), chars, symbols, len(dup), len(inside(3)), failed, not bad)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\n" * 80, "é\x85b \x1fc " * 60]
    for k in range(150):
        words = rng.choices(["da", "no", "été", "漢字", "#", "the|", "zz"] + [f"w{i}" for i in range(rng.choice([2, 20, 400]))], k=rng.randint(0, 300))
        t = "".join(w + rng.choice(" \n\t\r") for w in words)
        out.append(t + (t[: len(t) // 3] if k % 3 == 0 else ""))
    return out


def test_against_brute_force():
    for t in texts():
        m = quality.measure(t, quality.Limits())
        assert tuple(m[f] for f in FIELDS) == slow(t), t


def test_a_collision_changes_nothing():
    ids = np.array([1, 2, 3, 4, 5, 6])
    got = quality._equal_windows(ids, np.zeros(4, np.uint64), np.arange(4), 3)
    assert len(got) == 0
    ids = np.array([1, 2, 3, 1, 2, 3])
    assert list(quality._equal_windows(ids, np.zeros(4, np.uint64), np.arange(4), 3)) == [0, 3]


def test_frames(spark):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    got = Counter(tuple(r) for r in quality.report(df).select("doc_id", *FIELDS).collect())
    assert got == Counter((i, *slow(t)) for i, t, _ in rows)
    assert quality.report(df.limit(0)).count() == 0
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(slow(t)[-1] for _, t, _ in rows)
