"""Cases that all operators meet: bytes that are no UTF-8, very long texts, empty tables, extra columns with clashing names."""

import hashlib
import random
import zlib

import public_tokenizers
import test_simhash
from pyspark.sql import functions as F

from tessera.llm import bpe, lm, mixing, pii, quality, rollup, runs, sharding, simhash, tiff, warc

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DIGESTS = {
    "op1": quality.report, "op3": mixing.digest, "op4": sharding.digest, "op5": lm.scores, "op7": tiff.digests, "op8": pii.digest, "op9": simhash.digest,
    "op10": lambda df: bpe.round_trip(df, VOCABULARY, PATTERN), "op11": runs.digest,
}


def broken(spark):
    return spark.sql("SELECT CAST(X'61ff20c32062' AS STRING) AS text, 1L AS doc_id, 's' AS source, 'en' AS lang, 5 AS TEXT_ UNION ALL SELECT 'a b c', 2L, NULL, NULL, 6 UNION ALL SELECT NULL, NULL, 's', 'en', NULL")


def test_bytes_that_are_not_utf8(spark):
    df = broken(spark)
    for name, made in DIGESTS.items():
        assert sorted(str(r.doc_id) for r in made(df).collect()) == ["1", "2", "None"], name
    assert {r.doc_id: r.n_words for r in quality.report(df).collect()} == {1: 3, 2: 3, None: 0}
    assert simhash.one_of_each_group(df).count() == 3
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert rollup.totals(df, labels).count() == 2
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.payload_bytes, r.error) for r in warc.round_trip(pages).collect()}
    assert got == {1: (6, None), 2: (5, None), None: (0, None)}


def test_very_long_texts(spark):
    rng = random.Random(30)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = list(words)
    for _ in range(50):
        near[rng.randrange(len(near))] = "new"
    rows = [(1, " ".join(words), "s"), (2, "\n".join(near), "s"), (3, "same words here\n" * 50_000, "s"), (4, "x" * 2_000_000, "s"), (5, " ".join(words[:1000]), "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {r.doc_id: r for r in quality.report(df).collect()}
    assert report[1].n_words == 150_000 and report[1].kept and report[3].n_repeat_words == 150_000 and report[3].n_dup_lines == 49_999 and not report[3].kept and report[4].word_chars == 2_000_000
    prints = {r.doc_id: r.fingerprint for r in simhash.digest(df.filter("doc_id in (1, 4, 5)")).collect()}
    assert prints[1] == f"{test_simhash.slow_fingerprint(rows[0][1]):016x}" and prints[5] == f"{test_simhash.slow_fingerprint(rows[4][1]):016x}"
    assert sorted(r.doc_id for r in simhash.one_of_each_group(df).collect()) == [1, 3, 4, 5]


def test_empty_tables_and_clashing_columns(spark):
    df = broken(spark).limit(0)
    for name, made in DIGESTS.items():
        assert made(df).count() == 0, name
    both = bpe.encode(df, VOCABULARY, PATTERN)
    assert both.count() == 0 and bpe.decode(both, VOCABULARY, PATTERN).count() == 0
    rows = [(1, "a b", "s", 7, 8, 9)] * 2
    clash = spark.createDataFrame(rows, "doc_id long, text string, source string, Text int, SIZE int, fingerprint int")
    for name, made in DIGESTS.items():
        assert [r.doc_id for r in made(clash).collect()] == [1, 1], name


def test_names_that_differ_in_case_only(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", "other words here", "t", 9)], "doc_id long, text string, source string, lang string, TEXT string, Source string, DOC_ID int")
    labels = spark.createDataFrame([(2, 1, 0, 1)], "doc_id long, toxic int, Toxic int, Doc_Id int")
    assert [tuple(r) for r in rollup.totals(docs, labels).collect()] == [("s", "en", "marks-2", 1, 2)]
    pages = spark.createDataFrame([(1, "u", "<p>1</p>", "<p>long other</p>", 7, "x"), (2, "v", "<p>1</p>", "", 8, "x")], "page_id long, url string, html string, HTML string, Page_ID int, error string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.error) for r in warc.round_trip(pages).collect())
    assert got == [(1, 8, "response", None, None), (2, 8, "revisit", 1, None)]


def test_very_long_texts_in_the_other_operators(spark):
    """A text far above the others: sizes, stored bytes and tokens are of all of it, and the mix takes no more than its share."""
    rng = random.Random(31)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    rows = [(1, long, "s"), (2, "ab " * 40_000, "s"), *[(k, f"short text {k}", "t") for k in range(3, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.digest(df).collect()}
    assert taken[1][:2] == (60_000, 100_000) and taken[2][0] == 40_000 and all(t <= 2 * n for n, _, _, t in taken.values())
    assert abs(taken[1][3] + taken[2][3] - taken[1][2]) <= 1
    copies = {}
    for r in mixing.repeated(df).select("doc_id", F.sha2("text", 256).alias("sha")).collect():
        copies[r.doc_id, r.sha] = copies.get((r.doc_id, r.sha), 0) + 1
    whole = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _ in rows}
    assert all(whole[i] == sha and n <= 2 for (i, sha), n in copies.items()) and {i for i, _ in copies} & {1, 2}
    stored = {r.doc_id: r for r in tiff.digests(df).collect()}
    tokens = {r.doc_id: r for r in bpe.round_trip(df, VOCABULARY, PATTERN).collect()}
    for i, t, _ in rows:
        data = t.encode()
        padded = data + b"\0" * (-len(data) % 64)
        assert (stored[i].n_bytes, stored[i].payload_bytes, stored[i].payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert tokens[i].decoded_sha256 == whole[i]


def test_shards_by_rules_of_their_own(spark):
    """The law of op4 from its rows alone: near equal bytes, slots without gaps, and nothing lost, with one text held by a third of all rows."""
    rng = random.Random(32)
    rows = [(k, "a copy" if k % 3 == 0 else "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.digest(df).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == [(k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in rows]
    held, slots = {}, {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    even = sum(held.values()) / 16
    assert {r.law for r in got} == {"bytes"} and sorted(held) == list(range(16))
    assert all(abs(n - even) <= 0.01 * even + 121 for n in held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
