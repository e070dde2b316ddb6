import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return bpe.ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_on_random_texts(both):
    own, library = both
    rng = random.Random(3)
    alphabets = ["ab", "aA ", "the quick", "éèñßü ", "漢字かな", "0123456789 .,", "\n\t  x", "😀🎉a ", "'sdtll ve", "\x1c\x1d\x85  a\xa0"]
    for _ in range(3000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert own.encode(t) == library.encode_ordinary(t), repr(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_pieces_of_random_tokens(both):
    own, library = both
    rng = random.Random(4)
    tokens = [b for b in own.ranks if b.isalpha() and len(b) > 2]
    for _ in range(3000):
        t = b"".join(rng.choices(tokens, k=rng.randint(1, 6))).decode("utf-8", "ignore")
        assert own.encode(t) == library.encode_ordinary(t), repr(t)


def test_compatible_pairs_are_those_that_merging_leaves(both):
    own, _ = both
    rng = random.Random(5)
    tokens = sorted(own.token)
    short = [i for i in tokens if len(own.token[i]) <= 3]
    for _ in range(20_000):
        a, b = rng.choice(rng.choice([tokens, short])), rng.choice(rng.choice([tokens, short]))
        assert own.compatible(a, b) == (own.merged(own.token[a] + own.token[b]) == [a, b]), (a, b)


def test_forgetting_changes_nothing(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    t = " ".join(f"word{i} über漢字 unlikelihood{i % 7}" for i in range(500))
    assert own.encode(t) == library.encode_ordinary(t)


def test_long_pieces_take_linear_time(both):
    own, library = both
    for unit in ("a", " ", "ab", "漢"):
        t = unit * 200_000
        assert own.decode(own.encode(t)) == t.encode()
    assert own.encode("ab" * 2000) == library.encode_ordinary("ab" * 2000)
    assert own.encode(" " * 3000) == library.encode_ordinary(" " * 3000)


def test_frame_with_nulls_repeats_and_clashing_columns(spark, both):
    own, library = both
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (3, "Déjà vu, 'tis 42!\n" * 50, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN, into="again").select("text", "again").collect()
    assert all((r.text or "") == r.again for r in back)
