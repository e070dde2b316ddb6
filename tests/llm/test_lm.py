import math
import random
from collections import Counter

import pytest

from tessera.llm import lm


def slow(texts, order):
    """Stupid backoff of one word up to order, by the counts of all other texts."""
    lists = [(t or "").encode().split() for t in texts]
    grams = lambda x, k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    every = [sum((grams(x, k) for x in lists), Counter()) for k in range(1, order + 1)]
    total = sum(map(len, lists))
    out = []
    for x in lists:
        own = [grams(x, k) for k in range(1, order + 1)]
        rest = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(x)):
            for k in range(min(i + 1, order), 0, -1):
                g = tuple(x[i + 1 - k : i + 1])
                if k > 1 and rest(g):
                    s += math.log10(rest(g) / rest(g[:-1]))
                    break
                s += math.log10(max(rest(g), 1) / max(total - len(x), 1)) if k == 1 else math.log10(lm.BACKOFF)
        out.append((len(x), s, s / len(x) if x else None))
    return out


def compare(df, rows, n=lm.ORDER):
    order = lambda r: (str(r[0]), r[1], r[2])
    want = sorted(((r[0], *s) for r, s in zip(rows, slow([r[1] for r in rows], n), strict=True)), key=order)
    got = sorted(map(tuple, lm.scores(df, order=n).collect()), key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[2] - w[2]) < 1e-3 and (g[3] is None) == (w[3] is None) and abs((g[3] or 0) - (w[3] or 0)) < 1e-4


@pytest.mark.parametrize("block, part", [(700, 50), (4 << 20, 3000)])
def test_against_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "PART_GRAMS", part)
    rng = random.Random(15)
    texts = [None, "", " ", "alone"] + [" ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["the pair " * 400]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, UID string").repartition(5)
    for order in (1, 2, 3):
        compare(df, rows, order)
    assert lm.scores(df.limit(0)).count() == 0


def test_a_table_read_from_files(spark, tmp_path):
    rng = random.Random(16)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randint(1, 80)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    compare(spark.read.parquet(f"{tmp_path}/d"), rows)


def test_a_very_long_text_and_one_document(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    compare(spark.createDataFrame([(1, long)], "doc_id long, text string"), [(1, long)])
    rows = [(1, long), (2, "w1 w2 w3 w9 w10 none"), (3, "a\x0bb c 　")]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rare_words_keep_their_identity(spark):
    rows = [(1, "rare one two"), (2, "rare one two"), (3, "other one two")]
    got = {r.doc_id: r.log_score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == round(math.log10(1 / 6), 4) + 0.0 and got[3] < got[1]


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff2062' AS STRING) AS text UNION ALL SELECT 2L, 'a b'")
    assert {(r.doc_id, r.n_words) for r in lm.scores(df).collect()} == {(1, 2), (2, 2)}


@pytest.mark.parametrize("most", [lm.BLOCK_BYTES, 3000])
def test_settings_that_change_move_no_block(spark, tmp_path, monkeypatch, most):
    """Files are split anew between the call and the action, and the settings are those of the caller afterwards."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", most)
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    df = spark.read.parquet(f"{tmp_path}/d")
    found = lm.scores(df)
    spark.conf.set(name, "3000")
    try:
        got = {r.doc_id: r.log_score for r in found.collect()}
        again = {r.doc_id: r.log_score for r in lm.scores(spark.read.parquet(f"{tmp_path}/d")).collect()}
        assert spark.conf.get(name) == "3000" and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    finally:
        spark.conf.set(name, before)
    want = {k: s for (k, _), (_, s, _) in zip(rows, slow([t for _, t in rows], lm.ORDER), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 and abs(again[k] - want[k]) < 1e-3 for k in want)


def test_counts_of_another_block_are_refused():
    import numpy as np

    sizes, doc, grams = lm.ngrams([b"a b c"], 2)
    with pytest.raises(ValueError, match="counted"):
        lm._log_scores(sizes, doc, grams, np.zeros(3, np.uint64), 3)
