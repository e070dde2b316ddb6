"""Operator 1: quality rules from repetition.

Each text is cut into words and lines. Words become small integers, and a rolling
hash (h' = h * B + id, modulo 2^64) is carried from one n-gram length to the next,
so each further length costs one vector multiplication. Windows with equal hashes
are compared word by word, so a collision changes nothing. For every length the
characters of the words inside repeated n-grams are summed, and so are those of
repeated lines; a text fails where such a share of its characters is too large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, plain, small_batches, take

#: Characters that count as symbols; fixed by the contract.
SYMBOLS = "#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Shares in hundredths; a text fails if a measured share is above its limit."""

    min_words: int = 50
    repeat_words: int = 50
    #: n-gram length: characters inside repeated n-grams to all word characters.
    ngrams: tuple = ((5, 40), (6, 38), (7, 36), (8, 34), (9, 32), (10, 30))
    #: Characters in lines that repeat an earlier line, to all characters in lines with words.
    line_chars: int = 30
    #: Symbols to words.
    symbols: int = 10


def _equal_windows(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n words at starts, those whose words occur at another start too."""
    order = np.argsort(hashes, kind="stable")
    h, s = hashes[order], starts[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return starts[:0]
    left, right = s[:-1][same], s[1:][same]
    for k in range(n):
        if (ids[left + k] != ids[right + k]).any():  # a collision: group by the words themselves
            rows = np.stack([ids[starts + j] for j in range(n)], axis=1)
            _, at, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            return starts[count[at.ravel()] > 1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(s[twice])


def repeated_windows(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, the starts of windows that occur more than once."""
    out, top = {}, max(lengths)
    starts = np.arange(len(ids))
    hashes = ids.astype(np.uint64)
    ids = ids.astype(np.int64)
    for n in range(2, top + 1):
        keep = starts + n <= len(ids)
        starts, hashes = starts[keep], hashes[keep]
        with np.errstate(over="ignore"):
            hashes = hashes * BASE + ids[starts + n - 1].astype(np.uint64) + np.uint64(1)
        if n in lengths:
            out[n] = _equal_windows(ids, hashes, starts, n)
            # only a window whose first n words repeat can repeat when it is longer
            kept = np.isin(starts, out[n], assume_unique=True) if len(out[n]) < len(starts) else slice(None)
            starts, hashes = starts[kept], hashes[kept]
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """A mask of the words inside windows of n words at starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | bytes | None, limits: Limits) -> dict:
    """The measurements of a text; bytes that are not UTF-8 count as U+FFFD."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen, dup_lines, dup_chars, line_chars = set(), 0, 0, 0
    for x in lines:
        line_chars += len(x)
        if x in seen:
            dup_lines += 1
            dup_chars += len(x)
        seen.add(x)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n_words)
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    if sizes.sum() != word_chars:  # not ASCII only: code points, not bytes
        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
    lengths = [3, *(n for n, _ in limits.ngrams)]
    found = repeated_windows(ids, lengths) if n_words >= 3 else {}
    none = np.zeros(0, np.int64)
    n_repeat = int(covered(found.get(3, none), 3, n_words).sum()) if n_words else 0
    chars = {n: int(sizes[covered(found.get(n, none), n, n_words)].sum()) if n_words else 0 for n, _ in limits.ngrams}
    n_symbols = sum(map(text.count, SYMBOLS))
    base_failed = n_words < limits.min_words or 100 * n_repeat > limits.repeat_words * n_words
    repeated = any(100 * chars[n] > most * word_chars for n, most in limits.ngrams)
    lined = 100 * dup_chars > limits.line_chars * line_chars
    symbolic = 100 * n_symbols > limits.symbols * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "base_failed": base_failed,
        "dup_line_chars": dup_chars, "line_chars": line_chars, "dup_ngram_chars": [chars[n] for n, _ in limits.ngrams],
        "kept": not (base_failed or repeated or lined or symbolic),
    }


REPORT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,dup_line_chars:bigint,line_chars:bigint,dup_ngram_chars:array<bigint>,kept:boolean>"


def report_column(column, limits: Limits = Limits()):
    """The measurements of a text column as a struct; a null text is measured as an empty one, and fails."""
    kind = pa.struct([
        *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()),
        ("dup_line_chars", pa.int64()), ("line_chars", pa.int64()), ("dup_ngram_chars", pa.list_(pa.int64())), ("kept", pa.bool_()),
    ])

    @F.arrow_udf(REPORT)
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t, limits) for t in texts.to_pylist()], kind)

    return measured(column.cast("binary"))


def report(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of df: the key and the measurements, with the verdict in `kept`.

    Null and empty texts have zero counts and fail; bytes that are not UTF-8 count as
    U+FFFD; repeated rows give repeated rows; a null key stays null; an empty table gives an empty one; other columns
    are dropped.
    """
    small_batches(df.sparkSession)
    own = take(df, key, text)
    return own.select(key, report_column(own[text], limits).alias("report")).select(key, "report.*")


def keep(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of df whose text passes, with all their columns; null and empty texts don't, and repeated rows are judged alike; an empty table gives an empty one."""
    small_batches(df.sparkSession)
    wide, (at,) = plain(df, text)
    return wide.filter(report_column(wide[at], limits)["kept"]).toDF(*df.columns)
