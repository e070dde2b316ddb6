import base64
import hashlib
import random
import struct
from collections import Counter

import zstandard

from tessera.llm import warc


def pages():
    rng = random.Random(9)
    out = [(1, None, None, 0), (2, "http://x/ü\r\nA: b", "", 0), (3, "u", "<p>same</p>", 0), (None, "u", "<p>same</p>", 0), (None, "n", "only null", 0), (None, "n", "only null", 0), (9, "u", "é" * 5000, 0)]
    out += [(10 + i, f"http://h/{i}", rng.choice(["<p>same</p>", f"<html><body>{i} {rng.random()}</body></html>"]), 0) for i in range(300)]
    return [*out, (3, "u", "<p>same</p>", 0)]


def want(rows):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = Counter()
    for i, _, h, _ in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        out[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None, None] += 1
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, HTML2 int").repartition(3)
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want(pages())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_are_archives_for_any_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 1500)
    monkeypatch.setattr(warc, "ROWS", 6)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, x int").coalesce(1)
    warc.write(df, f"file://{tmp_path}/a")
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) >= 7
    seen = 0
    for f in files:
        data = f.read_bytes()
        assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_SKIPPABLE
        whole = zstandard.ZstdDecompressor(dict_data=warc.read_dictionary(data)).stream_reader(data, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")
        seen += len(list(warc.records(data)))
        assert all(not isinstance(r, str) for _, r in warc.records(data))
    assert seen == len(pages())
    texts = {r.record_id: bytes(r.payload).decode() for r in warc.read(spark, f"file://{tmp_path}/a").collect() if r.payload is not None}
    assert texts["urn:x-page:9"] == "é" * 5000


def test_large_pages_end_an_archive_early(spark, tmp_path):
    rng = random.Random(3)
    large = ["".join(chr(rng.randrange(33, 127)) for _ in range(1 << 20)) * 20] * 2 + [rng.randbytes(9 << 20).hex() for _ in range(12)]
    rows = [(f"id {i}/é%:+", "u", t) for i, t in enumerate(large)] + [(f"small {i}", None, str(i)) for i in range(5)] + [("", "u", "x"), (None, "u", "y")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert set(got) == {r[0] for r in rows} and all(r.error is None and r.payload_digest == warc.digest(t.encode()) for i, _, t in rows for r in [got[i]])
    assert got["id 1/é%:+"].refers_to == "id 0/é%:+" and got["id 1/é%:+"].payload_bytes == 20 << 20
    warc.write(df, f"file://{tmp_path}/a")
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 2 and max(sizes) < 90 << 20


def test_pages_are_not_moved_to_find_copies(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, x int")
    plan = warc.shared_payloads(df, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("Exchange")[1].split("\n")[0]


def test_faults_are_reported():
    good = warc.record("response", "urn:x-page:1", "u", b"body", warc.digest(b"body"), 4, None)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"body", b"bodies"), good.replace(b"body", b"eggs"), good.replace(b"WARC-Date", b"X-Date"), good[:-2]):
        packed = zstandard.compress(bad)
        ((_, got),) = warc.records(packed)
        assert isinstance(got, str)
    data = zstandard.compress(good) * 3
    rng = random.Random(1)
    for _ in range(300):
        broken = bytearray(data)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        list(warc.records(bytes(broken)))
        list(warc.records(data[: rng.randrange(len(data))]))
    words = b"plain words " * 50
    for held in (words, zstandard.compress(words)):
        d = warc.read_dictionary(struct.pack("<II", warc.DICTIONARY_SKIPPABLE, len(held)) + held)
        assert d.as_bytes() == words
