"""Operator 7: TIFF columns, one row per page.

The reader walks the chain of image directories in either byte order, fetches
each strip or tile, undoes its compression (none, LZW, deflate, PackBits), then
the predictor (horizontal differencing, or floating point), and assembles the
page. A directory that is visited twice ends the walk. What cannot be read gives
a row with `error` set, never a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import small_batches, take

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: struct codes by field type.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
#: A page that would take more bytes is an error, so that a forged header cannot take the memory.
MOST_BYTES = 1 << 30


class BadTiff(ValueError):
    pass


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; ends at the end code, the end of data or after size bytes."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out, made = first[:], 9, 0, 0, b"", [], 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or made >= size:
            break
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise BadTiff("LZW code out of range")
        out.append(now)
        made += len(now)
        if last:
            table.append(last + now[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        last = now
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 256, 9, 9  # begins with a clear code
    table: dict[int, int] = {}
    free, code = 258, -1

    def put(value: int) -> None:
        nonlocal held, bits
        held, bits = held << width | value, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = table.get(code << 8 | byte)
        if longer is not None:
            code = longer
            continue
        put(code)
        table[code << 8 | byte] = free
        free += 1
        if free in (512, 1024, 2048):
            width += 1
        if free == 4095:
            put(256)
            table.clear()
            free, width = 258, 9
        code = byte
    if code >= 0:
        put(code)
        free += 1
        if free in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while at < len(data) and made < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        made += len(part)
    return b"".join(out)[:size]


def packbits_encode(rows: np.ndarray) -> bytes:
    """Each row by itself, as the format asks; runs of three bytes or more are repeats."""
    out = []
    runs = (rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])
    for row, mixed in zip(rows, runs.any(axis=1) if runs.size else np.zeros(len(rows), bool), strict=True):
        data = row.tobytes()
        literal, at = 0, 0
        if mixed:
            ends = [*np.flatnonzero(row[1:] != row[:-1]) + 1, len(data)]
            for end in map(int, ends):
                if end - at >= 3:
                    for k in range(literal, at, 128):
                        out.append(bytes([min(128, at - k) - 1]) + data[k : min(k + 128, at)])
                    for k in range(at, end, 128):
                        n = min(128, end - k)
                        out.append(bytes([257 - n if n > 1 else 0, data[k]]))
                    literal = end
                at = end
        for k in range(literal, len(data), 128):
            out.append(bytes([min(128, len(data) - k) - 1]) + data[k : k + 128])
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size or 1)[:size]
    except zlib.error as e:
        raise BadTiff(f"deflate: {e}") from None


@dataclass
class Page:
    width: int = 0
    height: int = 0
    bits: int = 0
    samples: int = 0
    compression: int = 0
    predictor: int = 1
    tiled: bool = False
    pixels: np.ndarray | None = None
    error: str | None = None
    tags: dict = field(default_factory=dict)


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict, int]:
    head, entry, tail, slot = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    (count,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize(head)
    tags = {}
    for k in range(count):
        place = at + entry * k
        tag, kind, n = struct.unpack_from(order + "HH" + tail, data, place)
        code = FIELD.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * n
        if size > len(data):
            raise BadTiff(f"tag {tag} is longer than the file")
        value = place + entry - slot
        if size > slot:
            (value,) = struct.unpack_from(order + tail, data, value)
        tags[tag] = struct.unpack_from(f"{order}{n}s" if code == "s" else f"{order}{n * len(code)}{code[0]}", data, value)
    (after,) = struct.unpack_from(order + tail, data, at + entry * count)
    return tags, after


def _unpredict(part: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """part: rows x width x samples."""
    if predictor == 1:
        return part
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=part.dtype)
    if predictor == 3 and part.dtype.kind == "f":
        rows, width, samples = part.shape
        size = part.dtype.itemsize
        flat = np.frombuffer(part.tobytes(), np.uint8).reshape(rows, -1, samples)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, samples)
    raise BadTiff(f"predictor {predictor}")


def _page(data: bytes, tags: dict, order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    page = Page(one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(259, 1), one(317, 1), 322 in tags, tags=tags)
    if not page.width or not page.height:
        raise BadTiff("no width or height")
    if len(set(tags.get(258, (1,)))) > 1 or page.bits not in (1, 8, 16, 32, 64):
        raise BadTiff(f"bits per sample {tags.get(258)}")
    if page.width * page.height * page.samples * max(page.bits, 8) // 8 > MOST_BYTES:
        raise BadTiff("the page is too large")
    planes, deep = (page.samples, 1) if one(284, 1) == 2 else (1, page.samples)
    if page.tiled:
        wide, high = one(322), one(323)
        offsets, counts = tags.get(324), tags.get(325)
    else:
        wide, high = page.width, min(one(278, page.height), page.height)
        offsets, counts = tags.get(273), tags.get(279)
    if not wide or not high or not offsets or not counts:
        raise BadTiff("no strips or tiles")
    if wide * high * deep * max(page.bits, 8) // 8 > MOST_BYTES:
        raise BadTiff("a strip or tile is too large")
    across, down = -(-page.width // wide), -(-page.height // high)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise BadTiff("too few strips or tiles")
    letter = "f" if one(339, 1) == 3 else "i" if one(339, 1) == 2 else "u"
    kind = np.dtype(np.uint8 if page.bits <= 8 else f"{order}{letter}{page.bits // 8}")
    out = np.zeros((page.height, page.width, page.samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if page.tiled else min(high, page.height - y)
        line = -(-wide * deep * page.bits // 8)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if one(266, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
        if page.compression == NONE:
            raw = raw[: rows * line]
        elif page.compression == LZW:
            raw = lzw_decode(raw, rows * line)
        elif page.compression in (DEFLATE, OLD_DEFLATE):
            raw = inflate(raw, rows * line)
        elif page.compression == PACKBITS:
            raw = packbits_decode(raw, rows * line)
        else:
            raise BadTiff(f"compression {page.compression}")
        if len(raw) < rows * line:
            raise BadTiff("a strip or tile is too short")
        if page.bits == 1:
            part = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * deep].reshape(rows, wide, deep)
        else:
            part = np.frombuffer(raw, kind).reshape(rows, wide, deep)
        part = _unpredict(part, page.predictor, order)
        h, w = min(rows, page.height - y), min(wide, page.width - x)
        out[y : y + h, x : x + w, plane if planes > 1 else slice(None)] = part[:h, :w, 0] if planes > 1 else part[:h, :w]
    page.pixels = out
    return page


def pages(data: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF or BigTIFF. Null, empty or damaged data end with a page that has an error."""
    try:
        order = {b"II": "<", b"MM": ">"}.get((data or b"")[:2])
        if order is None:
            raise BadTiff("no TIFF header")
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic not in (42, 43):
            raise BadTiff(f"magic {magic}")
        big = magic == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(data, at, order, big)
            yield _page(data, tags, order)
        if at:
            raise BadTiff("the directories form a loop")
    except (BadTiff, struct.error, ValueError) as e:
        yield Page(error=str(e)[:200] or type(e).__name__)


def tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = 1024) -> bytes:
    """A little-endian TIFF of grey 8-bit pages; the same pages and settings give the same bytes."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile), np.uint8)
            full[:height, :width] = image
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = part.tobytes()
            packed = lzw_encode(raw) if compression == LZW else zlib.compress(raw, 6) if compression == DEFLATE else packbits_encode(part) if compression == PACKBITS else raw
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        entries = {256: width, 257: height, 258: 8, 259: compression, 262: 1, 277: 1, 317: predictor}
        entries |= {322: tile, 323: tile, 324: offsets, 325: counts} if tile else {273: offsets, 278: strip_rows, 279: counts}
        fields = b""
        for tag, value in sorted(entries.items()):
            values = value if isinstance(value, list) else [value]
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, place = struct.pack("<I", len(out)), data
                out += place
            fields += struct.pack("<HHI", tag, 4, len(values)) + data
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(fields)
        out += struct.pack("<H", len(entries)) + fields + struct.pack("<I", 0)
    return bytes(out)


def features(pixels: np.ndarray) -> str:
    """Size, mean in thousandths, and the counts of eight bands of brightness, of 8-bit samples."""
    bands = np.bincount(pixels.reshape(-1) >> 5, minlength=8)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{int(pixels.sum(dtype=np.int64)) * 1000 // pixels.size};" + "-".join(map(str, bands))


#: How a text is stored goes by its checksum: (compression, predictor, tile).
FORMS = ((DEFLATE, 2, 0), (DEFLATE, 1, 64), (LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 1, 0), (LZW, 2, 64), (NONE, 1, 0), (DEFLATE, 2, 64))


def text_image(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length of a text, and a TIFF of 64 columns that holds those bytes and zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    padded = data + b"\0" * (-len(data) % 64 if data else 64)
    compression, predictor, tile = FORMS[zlib.crc32(padded) % len(FORMS)]
    return len(data), tiff([np.frombuffer(padded, np.uint8).reshape(-1, 64)], compression, predictor, tile)


def text_images(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, n_bytes, and the text's bytes as a TIFF in `media`.

    Null texts count as empty ones; equal texts give equal files; repeated rows give
    repeated rows; a null key stays null; an empty table gives an empty one; other
    columns are dropped.
    """

    @F.arrow_udf("struct<n_bytes:bigint,media:binary>")
    def stored(texts: pa.Array) -> pa.Array:
        rows = [text_image(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())], ["n_bytes", "media"])

    small_batches(df.sparkSession)
    own = take(df, key, text)
    return own.select(key, stored(own[text].cast("binary")).alias("stored")).select(key, "stored.*")


PAGE = "page int, width long, height long, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def read_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the TIFF in each row's media column: df's other columns, then PAGE.

    Null, empty or damaged media give one row, after the pages that could be read,
    with `error` set and no pixels. Columns of df with a name of PAGE are left out.
    Pixels are row by row, samples in native byte order. Repeated rows are read
    each by itself; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    made = T._parse_datatype_string(PAGE)
    names = {f.name for f in made.fields}
    kept = [c for c in df.columns if c != media and c.lower() not in names]
    own = take(df, *kept, media)
    schema = T.StructType([*(f for f in own.schema.fields if f.name != media), *made.fields])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.string()]

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for k, p in enumerate(pages(batch.column(len(kept))[i].as_py())):
                    grey = p.pixels is not None and p.pixels.dtype == np.uint8
                    row = [k, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.tiled, None if p.pixels is None else p.pixels.tobytes(), features(p.pixels) if grey else None, p.error]
                    columns = [batch.column(j).slice(i, 1) for j in range(len(kept))] + [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(read, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: each text is stored as a TIFF of one page, read back, and what was stored and read is described.

    Null texts count as empty ones, and an empty one has 64 bytes of padding; equal texts
    give equal values; repeated rows give repeated rows; a null key stays null; an empty
    table gives an empty one; other columns are dropped.
    """
    media = text_images(df, key, text).select(key, "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = read_pages(media)
    return read.select(
        key, "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
