"""Operator 6: WARC archives in Zstandard.

An archive begins with a skippable frame that holds the dictionary; then each
record is a frame of its own. The reader loads the dictionary, walks the block
headers to find where each frame ends, decodes one frame per record, and
validates its version line, header fields, block length and digests. What is not
valid gives a row with `error` set.

Archives are written with Spark's text writer, so that they reach any store that
Spark writes to: each row is the bytes of some frames, and the line separator is a
skippable frame of no bytes, which every Zstandard reader passes over. Archives end
at some 64 MB, so that one fits in a task; it is read as Spark's binary files are,
and decoded a frame at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import new_path, sent_if_small, small_batches, take

#: Fixed values of the formats.
ZSTD_FRAME, ZSTD_DICTIONARY, FIRST_SKIPPABLE, DICTIONARY_SKIPPABLE = 0xFD2FB528, 0xEC30A437, 0x184D2A50, 0x184D2A5D
NOTHING = struct.pack("<II", FIRST_SKIPPABLE, 0)
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A row holds frames of ROW_BYTES or more, an archive ROWS rows, with the dictionary's; larger rows count for as many as they have times the bytes.
ROW_BYTES, ROWS = 1 << 20, 64
#: What the dictionary is trained on: at most so many pages, so many characters of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 4096, 16_384
#: A record that claims more bytes is not decoded.
MOST_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"


class BadArchive(ValueError):
    pass


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its headers alone."""
    if len(data) - at < 8:
        raise BadArchive("truncated frame")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & ~15 == FIRST_SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, at + 4)
        end = at + 8 + size
    elif magic == ZSTD_FRAME:
        flags = data[at + 4]
        single, content = flags >> 5 & 1, flags >> 6
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[content]
        last = False
        while not last:
            if end + 3 > len(data):
                raise BadArchive("truncated frame")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise BadArchive("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise BadArchive(f"no frame begins with {magic:08x}")
    if end > len(data):
        raise BadArchive("truncated frame")
    return end


def read_dictionary(data: bytes | memoryview) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of the leading skippable frame; it may itself be compressed. None if there is no such frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_SKIPPABLE:
        return None
    held = bytes(data[8 : frame_end(memoryview(data), 0)])
    if held[:4] == struct.pack("<I", ZSTD_FRAME):
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MOST_BYTES)
    trained = held[:4] == struct.pack("<I", ZSTD_DICTIONARY)
    return zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT) if held else None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, size: int, refers_to: str | None) -> bytes:
    """A response with its payload in an HTTP message, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), uri) if uri else "urn:x-unknown"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, block and payload, once version, fields, lengths and digests are found valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive("a header line is not name: value")
        fields.setdefault(name.lower(), value.strip())
    for name in NEEDED:
        if not fields.get(name.lower()):
            raise BadArchive(f"no {name}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the block's length is not Content-Length")
    block = rest[:-4]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != digest(block):
        raise BadArchive("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    length = int(said[1]) if said else len(payload)
    if fields["warc-type"] == "response":
        if length != len(payload):
            raise BadArchive("the payload's length is not that of its HTTP header")
        if fields.get("warc-payload-digest", "").startswith("sha1:") and fields["warc-payload-digest"][5:] != digest(payload):
            raise BadArchive("the payload's digest differs")
    return {"fields": fields, "payload": payload, "length": length}


def records(data) -> Iterator[tuple[int, dict | str]]:
    """Offset and parsed record, or what is wrong with it, for each frame. Walking ends where no frame boundary is found."""
    data, at = memoryview(data).cast("B"), 0
    try:
        reader = zstandard.ZstdDecompressor(dict_data=d) if (d := read_dictionary(data)) else zstandard.ZstdDecompressor()
    except (BadArchive, zstandard.ZstdError) as e:
        yield 0, f"dictionary: {e}"
        return
    while at < len(data):
        try:
            end = frame_end(data, at)
        except BadArchive as e:
            yield at, str(e)
            return
        if struct.unpack_from("<I", data, at)[0] == ZSTD_FRAME:
            try:
                frame = bytes(data[at:end])
                if not 0 < zstandard.get_frame_parameters(frame).content_size <= MOST_BYTES:
                    raise BadArchive("a frame of unknown or too large size")
                yield at, parse(reader.decompress(frame))
            except (BadArchive, zstandard.ZstdError) as e:
                yield at, str(e)[:200]
        at = end


def train(df: DataFrame, key: str, html: str) -> bytes:
    """A dictionary from a sample of pages; where they are too few to train on, their text itself.

    The pages are those with the smallest hashes among about four times as many that
    a hash picks, so that what reaches the driver is the same for any number of tasks.
    """
    parts = df.select(F.xxhash64(key, F.lit("sample")).alias("h"), F.left(F.coalesce(df[html], F.lit("")), F.lit(SAMPLE_CHARS)).alias("part"))
    one_in = max(1, df.count() // (4 * SAMPLE_PAGES))
    sample = parts.filter(F.pmod("h", F.lit(one_in)) == 0).orderBy("h", "part").limit(SAMPLE_PAGES).collect()
    texts = [record("response", "urn:x-page:0", "http://example.org/", r.part.encode("utf-8", "replace"), "A" * 32, 0, None) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def shared_payloads(df: DataFrame, key: str, html: str, least: int = 0) -> DataFrame:
    """sha1 (20 bytes) and first, the smallest key, of the payloads of least bytes or more that several rows have. No payload is moved for it."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = df.filter(F.octet_length(payload) >= least).select(F.unhex(F.sha1(payload)).alias("sha1"), key)
    return rows.groupBy("sha1").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")


def _name(key: Column) -> Column:
    """A record's id: the key as text, percent-encoded; keys of any type are told apart from null."""
    return F.coalesce(F.concat(F.lit("urn:x-page:"), F.url_encode(key.cast("string"))), F.lit("urn:x-null"))


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Writes one record per row of df below path, of equal payloads one response (that of the smallest key) and revisits to it.

    A null html is an empty payload. A record of null key is a response if no equal
    payload has a key, and never referred to. Repeated rows give repeated records, each
    of the smallest key a response. An empty table gives no records; other columns are
    left out.
    """
    own = take(df, key, url, html).toDF("key", "url", "html")
    spark = df.sparkSession
    small_batches(spark)
    words = train(own, "key", "html")
    lead = struct.pack("<II", DICTIONARY_SKIPPABLE, len(words)) + words
    held = spark.sparkContext.broadcast(lead)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    shared = sent_if_small(shared_payloads(own, "key", "html", least), "warc-shared")
    rows = own.withColumn("sha1", F.unhex(F.sha1(payload))).join(shared, "sha1", "left")
    again = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), _name(F.col("first")))
    rows = rows.select(_name(F.col("key")).alias("name"), "url", payload.alias("payload"), again.alias("again"))

    def frames(batches):
        words = read_dictionary(held.value)
        packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True, write_checksum=True)
        waiting, size, done = [], 0, 0

        def row():
            """The frames that wait, after the dictionary where an archive begins, and empty rows for what they have over ROW_BYTES."""
            nonlocal waiting, size, done
            out = [held.value] if done % ROWS == 0 else []
            out.append(b"".join(waiting))
            done += len(out)
            more = min(size // ROW_BYTES - 1, -done % ROWS)
            out += [b""] * max(more, 0)
            done += max(more, 0)
            waiting, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

        for b in batches:
            for name, url, payload, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                waiting.append(packer.compress(record("revisit" if again else "response", name, url, payload, digest(payload), len(payload), again)))
                size += len(waiting[-1])
                if size >= ROW_BYTES:
                    yield row()
        if waiting:
            yield row()

    made = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", ROWS).text(path)


RECORD = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path, or per fault, with `error` set.

    payload_digest is that of the payload itself in a response, and the one that the
    header claims in a revisit; payload_bytes is the length of the full payload.
    Without payloads, that column is null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def rows(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                out = []
                for at, got in records(data.as_buffer()):
                    row = {"file": name.as_py(), "offset": at}
                    if isinstance(got, str):
                        row["error"] = got
                    else:
                        f = got["fields"]
                        full = f["warc-type"] == "response"
                        row |= {"record_type": f["warc-type"], "record_id": f["warc-record-id"].strip("<>"), "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to", "").strip("<>") or None}
                        row |= {"payload_digest": digest(got["payload"]) if full else f.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": got["length"], "payload": got["payload"] if payloads and full else None}
                    out.append(row)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
                yield pa.RecordBatch.from_pylist(out, kind)

    return files.mapInArrow(rows, RECORD)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes df's pages to archives in the shared folder and reads them back: key, payload_bytes, payload_digest, record_type, refers_to, error.

    Null html counts as empty; repeated rows give repeated records; an empty table
    gives an empty one; other columns are dropped.
    """
    path = new_path(df.sparkSession, "warc")
    write(df, path, key, url, html, least)
    out = read(df.sparkSession, path, payloads=False)
    kind = take(df, key).schema[0].dataType
    back = lambda c: F.when(F.startswith(c, F.lit("urn:x-page:")), F.url_decode(F.substring(c, 12, 1 << 30)).cast(kind))
    return out.select(back("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"), "error")
