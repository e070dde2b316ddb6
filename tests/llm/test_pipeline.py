import random

import corpus_pipeline
from tessera.llm import bpe
from tessera.llm.base import written


def docs():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    rows.append((200, rows[0][1], "en", "s1", 1))
    rows.append((201, rows[1][1].replace(" ", " zz ", 1), "en", "s1", 1))
    rows.append((202, " ".join(word() for _ in range(80)) + " mail a@b.org", "en", "s2", 1))
    rows += [(203, None, None, None, None), (204, "short", "en", "s3", 1), (205, "same words here " * 60, "en", "s3", 1), (206, "# $ " * 100, "en", "s3", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, written(stage(spark, df, None), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == before.columns
        seen.append(df)
    quality, dedup, pii, mixed, tokens = seen
    clean = {*range(120), 200, 201, 202}
    assert {r.doc_id for r in quality.collect()} == clean
    assert {r.doc_id for r in dedup.collect()} == clean - {200, 201}
    texts = {r.doc_id: r.text for r in pii.collect()}
    assert texts[202].endswith("mail [EMAIL]") and texts[5] == docs()[5][1]
    mixed = [r.doc_id for r in mixed.collect()]
    assert set(mixed) <= set(texts) and max(map(mixed.count, mixed)) == 2
    own = bpe.ByteBPE(bpe.read_ranks(open(corpus_pipeline.VOCABULARY, "rb").read()), corpus_pipeline.public_tokenizers.PATTERN)
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.collect())
    assert got == sorted((i, len(own.encode(texts[i]))) for i in mixed)


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_nulls(spark):
    rows = [(*r, "x", None, 7) for r in docs()] + [(None, docs()[3][1] + " more", None, None, None, None, None, None), (None,) * 8]
    df = spark.createDataFrame(rows, SCHEMA + ", TEXT string, Doc_Id string, taken long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, None)
        assert out.columns == df.columns, name
        assert out.count() > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, df, None)
    assert tokens.count() == len(rows)
    both = bpe.encode(df, corpus_pipeline.VOCABULARY, corpus_pipeline.public_tokenizers.PATTERN, into="Taken")
    assert both.columns == [*df.columns[:-1], "Taken"] and both.count() == len(rows)


def slow_run(rows):
    """The pipeline in plain Python, from the brute-force versions of its operators."""
    import hashlib
    import math
    import re
    from collections import Counter, defaultdict

    import test_mixing
    import test_pii
    import test_quality
    import tiktoken

    rows = [r for r in rows if test_quality.slow(r[1])[-1]]
    sets = [set(zip(*(r[1].lower().split()[k:] for k in range(5)))) for r in rows]
    group = [r[0] for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    rows = [r for r, g in zip(rows, group, strict=True) if r[0] == g]

    def redacted(text):
        return test_pii.redacted(text, [(a, b, k) for k, spans in test_pii.base(text).items() for a, b in spans])

    rows = [(r[0], redacted(r[1]), r[3]) for r in rows]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    out = Counter()
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(corpus_pipeline.VOCABULARY, "rb").read()), special_tokens={})
    for s, target in test_mixing.water(sizes).items():
        def drawn(r):
            n, chars = len(r[1].split()), len("".join(r[1].split()))
            w = 1 + (n >= 50) + (3 * n <= chars <= 12 * n) + (10 * len(re.findall(r"[#*$%&|<>]", r[1])) <= n)
            return -math.log((int(hashlib.md5(f"mix-1:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
        epochs = math.floor(target / sizes[s])
        room = round(target - epochs * sizes[s])
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=drawn):
            n = len(t.split())
            ids = library.encode_ordinary(t)
            times = epochs + (2 * room >= n)
            room -= n
            if times:
                out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += times
    return out


def test_run_against_brute_force(spark, tmp_path):
    from collections import Counter

    rows = docs()
    rows += [(300 + k, rows[k][1].replace(" ", f" x{k} ", 1) + (" call +1 (017) 555-7713" if k % 2 else " at 10.0.0.1"), "en", f"s{k % 3}", 1) for k in range(0, 120, 7)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == slow_run(rows) and got.total() > 100
