import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from tessera.llm import rollup

SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokenizer string, old_tokens long, DOCS string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}


def test_random_changes_against_brute_force(spark, tmp_path):
    rng = random.Random(14)
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    live, batches = [], []
    for b in range(4):
        rows = []
        for _ in range(60):
            kind = rng.choice(["insert", "insert", "delete", "revise"]) if live else "insert"
            if kind == "insert":
                doc = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([0, 5, 1000]))
                live.append(doc)
                rows.append((kind, *doc, None, None))
            else:
                s, lang, v, n = live.pop(rng.randrange(len(live)))
                if kind == "delete":
                    rows.append((kind, s, lang, v, n, None, None))
                else:
                    live.append((s, lang, "v3", n + 1))
                    rows.append((kind, s, lang, "v3", n + 1, v, n))
        batches.append((f"b-{b}", frame(spark, rows)))
        assert r.commit(*batches[-1])
    want_docs, want_tokens = Counter(), Counter()
    for s, lang, v, n in live:
        want_docs[s, lang, v] += 1
        want_tokens[s, lang, v] += n
    want = {k: (n, want_tokens[k]) for k, n in want_docs.items()}
    assert totals(r) == want
    for folded in (4, 0):
        assert r.fold() == folded
        for name, changes in batches:
            assert not r.commit(name, changes)
        assert totals(r) == want
        with pytest.raises(rollup.BatchConflict):
            r.commit("b-0", batches[1][1])
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if not p.name.startswith(".")) == ["folds"]
    assert r.commit("later", frame(spark, [("insert", "a", "en", "v1", 7, None, None)]))
    assert totals(r) == want | {("a", "en", "v1"): (want.get(("a", "en", "v1"), (0, 0))[0] + 1, want.get(("a", "en", "v1"), (0, 0))[1] + 7)}


def test_a_fold_that_broke_off(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    one = frame(spark, [("insert", "a", "en", "v1", 7, None, None)])
    r.commit("one", one)
    (tmp_path / "kept").mkdir()
    import shutil

    shutil.copytree(tmp_path / "r/one", tmp_path / "kept/one")
    assert r.fold() == 1 and r.fold() == 0
    shutil.copytree(tmp_path / "kept/one", tmp_path / "r/one")  # as if it broke off before the folder was taken away
    assert totals(r) == {("a", "en", "v1"): (1, 7)} and r.batches() == []
    r.commit("two", one)
    r.totals().write.parquet(f"file://{tmp_path}/r/folds/1/totals")  # a fold without its ids
    assert totals(r) == {("a", "en", "v1"): (2, 14)}
    assert r.fold() == 1 and totals(r) == {("a", "en", "v1"): (2, 14)}
    assert not (tmp_path / "r/one").exists()


def test_broken_off_batches_do_not_count(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    changes = frame(spark, [("insert", "a", "en", "v1", 7, None, None), ("insert", "a", "en", "v1", None, None, None)])
    r.commit("one", changes)
    (tmp_path / "r/one/_SUCCESS").unlink()
    assert totals(r) == {}
    assert r.commit("one", changes)
    assert totals(r) == {("a", "en", "v1"): (2, 7)}
    with pytest.raises(PySparkException):
        r.commit("two", frame(spark, [("upsert", "a", "en", "v1", 7, None, None)]))
    r.commit("none", changes.limit(0))
    assert totals(r) == {("a", "en", "v1"): (2, 7)}


def test_history(spark):
    docs = spark.createDataFrame([(1, "a b, 12", "s", "en"), (2, None, None, None), (3, "x y", "s", "en"), (3, "x y", "s", "en"), (None, "q", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (1, None)], "doc_id long, toxic int")
    got = {tuple(r) for r in rollup.totals(docs, labels).collect()}
    assert got == {("s", "en", "marks-2", 2, 5), (None, None, "marks-2", 1, 0)}
    assert rollup.totals(docs.limit(0), labels).count() == 0 and rollup.totals(docs.limit(0), labels.limit(0)).count() == 0
    assert {tuple(r) for r in rollup.totals(docs, labels.limit(0)).collect()} == {("s", "en", "marks-2", 4, 9), (None, None, "marks-2", 1, 0)}
    long = spark.createDataFrame([(1, "ab 1;" * 200_000, "s", "en")], docs.schema)
    assert [tuple(r) for r in rollup.totals(long, labels).collect()] == [("s", "en", "marks-2", 1, 600_000)]


def test_a_session_without_markers_is_refused(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    one = frame(spark, [("insert", "a", "en", "v1", 7, None, None)])
    spark.conf.set(rollup.MARKS, "false")
    try:
        with pytest.raises(rollup.NoMarker):
            r.commit("one", one)
    finally:
        spark.conf.unset(rollup.MARKS)
    assert not (tmp_path / "r").exists() and totals(r) == {}
    assert r.commit("one", one) and totals(r) == {("a", "en", "v1"): (1, 7)}
