import random
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import simhash


def slow_fingerprint(text, width=3):
    out, text = "", text or ""
    for c in text:
        out += c.lower() if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c
    words = [w for w in out.split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def texts(n=120):
    rng = random.Random(10)
    out = [None, "", " \n", "one", "One", "one two", "É a b c", "é a b c"]
    for _ in range(n):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 400))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            again = list(words)
            for _ in range(rng.randint(0, 2)):
                again[rng.randrange(len(again))] = "new"
            out.append("\t".join(again))
    return out


def test_fingerprints():
    for t in texts():
        assert simhash.shingle_fingerprint(t) == slow_fingerprint(t)


def test_query_against_brute_force(spark):
    docs = [(i, t, "c") for i, t in enumerate(texts())]
    rng = random.Random(1)
    rng.shuffle(docs)
    df = spark.createDataFrame([*docs, docs[5], (None, "one", "c")], "doc_id long, text string, FINGERPRINT string").repartition(6)
    fps = [slow_fingerprint(t) for t in texts()]
    comp = slow_components(fps)
    want = Counter((i, f"{fps[i]:016x}", comp[i]) for i, _, _ in [*docs, docs[5]])
    want[None, f"{fps[3]:016x}", comp[3]] += 1
    assert Counter(map(tuple, simhash.digest(df).collect())) == want
    assert len(set(comp)) < len(set(fps))
    assert simhash.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_random_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(11)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(0, simhash._signed(x)) for x in fps], "family int, fp long")
    roots = {r.v: r.root for r in simhash.linked(df).collect()}
    got = defaultdict(set)
    for x in fps:
        got[roots.get(simhash._signed(x), simhash._signed(x))].add(x)
    want = defaultdict(set)
    for x, c in zip(fps, slow_components(fps), strict=True):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chains(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_one_of_each_group(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    near = list(base)
    near[7] = "other"
    rows = [(3, " ".join(base), "a", 1), (2, " ".join(near), "a", 2), (4, " ".join(base), "b", 3), (4, " ".join(base), "b", 4), (9, None, None, 5), (10, "", None, 6), (None, " ".join(base), "n", 7)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(300)), "u", 8) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, KEY int")
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 9, *range(100, 120)]
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_groups_are_what_similar_pairs_connect(spark):
    rng = random.Random(18)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 400))]
        for k in range(rng.choice([1, 2, 3])):
            again = list(base)
            for _ in range(k * rng.choice([1, 1, 2, 30])):
                again[rng.randrange(len(again))] = word()
            rows.append((len(rows), " ".join(again)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    similar = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(root)
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))
    assert any(root[i] != i for i in range(len(rows)))


def connected(rows, crowd=None):
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def test_copies_cut_off_or_with_text_appended(spark):
    rng = random.Random(19)
    word = lambda: f"w{rng.randrange(90000)}"
    rows = []
    for n in (40, 100, 400, 1500):
        for share in (0.06, 0.12, 0.18, 0.24, 0.3):
            for _ in range(3):
                base = [word() for _ in range(n)]
                rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((base, base + [word() for _ in range(int(n * share))], base[: int(n * (1 - share))]))]
    got = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == connected(rows)
    assert len(got) < len(rows)


@pytest.mark.parametrize("crowd", [4, 64])
def test_pairs_in_a_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(20)
    word = lambda: f"w{rng.randrange(90000)}"
    passage = [word() for _ in range(90)]
    rows = []
    for _ in range(60):
        start = [word() for _ in range(rng.randint(15, 30))]
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((len(rows), " ".join(passage + start + [word() for _ in range(rng.randint(0, 3))])))
    for _ in range(40):
        order = rng.sample(passage, len(passage))
        rows += [(len(rows) + k, " ".join(order + [word()] * k)) for k in range(2)]
    got = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == connected(rows)
    assert 40 < len(got) < len(rows)


@pytest.mark.parametrize("own_words", [48, 42, 12])
def test_texts_of_one_template_are_not_paired_off(spark, monkeypatch, own_words):
    """Rows made grow as rows read, whether what the texts share is too little for near copies or enough."""
    rng = random.Random(own_words)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(300)]
    own = lambda: [f"o{rng.randrange(10**7)}" for _ in range(own_words // 2)]
    made: dict[str, list[int]] = {}
    written = simhash.written

    def counted(df, label):
        out = written(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    for n in (150, 600):
        made.clear()
        df = spark.createDataFrame([(i, " ".join(own() + shared + own())) for i in range(n)], "doc_id long, text string")
        kept = simhash.one_of_each_group(df).count()
        assert kept == (1 if own_words == 12 else n)
        assert max(made["near-candidates"]) <= max(made["near-keys"])
        assert made["near-candidates"][1] <= 4 * n


def test_sizes_that_fit_lose_no_pair():
    """What a text of n shingles whose head meets another at a place can have in common bounds the sizes; against counting."""
    for n in range(1, 60):
        for pos in range(simhash._head_size(n)):
            largest = max((m for m in range(1, 200) if 9 * min(n - pos, m) >= 4 * (n + m)), default=0)
            limit = 9 * (n - pos) // 4 - n
            assert largest <= limit and all(9 * (n - pos) >= 4 * (n + m) for m in range(1, limit + 1))
