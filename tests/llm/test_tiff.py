import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import tiff


def image(rng, h, w):
    a = rng.integers(0, 256, (h, w), dtype=np.uint8)
    a[h // 3 : h // 2] = 7
    return a


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_round_trip_of_pages(compression, predictor, tile):
    rng = np.random.default_rng(1)
    images = [image(rng, h, w) for h, w in ((1, 1), (3, 200), (300, 64), (70, 33))]
    data = tiff.tiff(images, compression, predictor, tile, strip_rows=50)
    got = list(tiff.pages(data))
    assert [p.error for p in got] == [None] * 4
    for p, a in zip(got, images, strict=True):
        assert (p.pixels[:, :, 0] == a).all()


def test_codecs():
    rng = random.Random(2)
    for n in (0, 1, 2, 300, 5000, 70000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
            if n:
                assert tiff.packbits_decode(tiff.packbits_encode(np.frombuffer(data, np.uint8).reshape(1, -1)), n) == data


def test_known_streams():
    # the example of the PackBits description, and the LZW example of the TIFF description
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))
    assert tiff.packbits_decode(packed, 24) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data, 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def test_big_endian_sixteen_bits_with_predictor():
    a = np.array([[1000, 1003, 999], [5, 65535, 0]], ">u2")
    diff = np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], axis=1).astype(">u2").tobytes()
    tags = [(256, 3), (257, 2), (258, 16), (259, 8), (273, 0), (278, 2), (279, 0), (317, 2)]
    strip = zlib.compress(diff)
    at = 8 + len(strip)
    values = dict(tags) | {273: 8, 279: len(strip)}
    data = b"MM\0*" + struct.pack(">I", at) + strip + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, values[t]) for t, _ in tags) + struct.pack(">I", 0)
    (page,) = tiff.pages(data)
    assert page.error is None and (page.pixels[:, :, 0] == a).all()


def test_damaged_files_give_an_error():
    whole = tiff.tiff([np.arange(640, dtype=np.uint8).reshape(10, 64)] * 2)
    rng = random.Random(3)
    for data in (None, b"", b"II", b"II*\0", b"GIF89a", whole[: len(whole) // 2]):
        assert list(tiff.pages(data))[-1].error
    for _ in range(300):
        broken = bytearray(whole)
        for _ in range(4):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        list(tiff.pages(bytes(broken)))
    loop = bytearray(tiff.tiff([np.zeros((1, 64), np.uint8)]))
    loop[-4:] = loop[4:8]
    assert "loop" in list(tiff.pages(bytes(loop)))[-1].error


def test_query_against_brute_force(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "漢字 text\n" * 5000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, MEDIA binary")
    got = {r.doc_id or 0: r for r in tiff.digests(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[6][1:] == got[7][1:]
    assert tiff.digests(df.limit(0)).count() == 0


def test_rows_per_page(spark):
    rng = np.random.default_rng(4)
    data = tiff.tiff([image(rng, 9, 9), image(rng, 20, 5)], tiff.LZW, 2)
    df = spark.createDataFrame([(1, bytearray(data), 5), (2, None, 6)], "id int, media binary, PAGE int")
    rows = sorted(tiff.read_pages(df).select("id", "page", "height", "error").collect())
    assert [(r.id, r.page, r.height) for r in rows] == [(1, 0, 9), (1, 1, 20), (2, 0, 0)] and rows[2].error


@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor(order):
    a = np.array([[1.5, -2.25, 3e7, 0.1], [0, 1, 2, -1e-9]], np.float32)
    planes = a.astype(">f4").view(np.uint8).reshape(2, 4, 4).transpose(0, 2, 1).reshape(2, 16)
    diff = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8)
    strip = zlib.compress(diff.tobytes())
    values = {256: 4, 257: 2, 258: 32, 259: 8, 273: 8, 278: 2, 279: len(strip), 317: 3, 339: 3}
    at = 8 + len(strip)
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + strip + struct.pack(order + "H", len(values)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in values.items()) + struct.pack(order + "I", 0)
    (page,) = tiff.pages(data)
    assert page.error is None and (page.pixels[:, :, 0] == a).all()


def test_big_tiff():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    values = {256: 4, 257: 3, 258: 8, 259: 1, 273: 16, 278: 3, 279: 12}
    data = b"II+\0" + struct.pack("<HHQ", 8, 0, 28) + a.tobytes() + struct.pack("<Q", len(values)) + b"".join(struct.pack("<HHQQ", t, 4, 1, v) for t, v in values.items()) + struct.pack("<Q", 0)
    (page,) = tiff.pages(data)
    assert page.error is None and (page.pixels[:, :, 0] == a).all()
