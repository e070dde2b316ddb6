"""Operator 11: periodic runs of words.

A run is a stretch of consecutive words with smallest period q, at least twice that
long, that no neighbouring word extends. Such a stretch holds an aligned block of a
power of two of words, of a size that its period sets, and the same block q words
later. So for each size the aligned blocks are the keys of an Aho-Corasick automaton
over integer sequences, the document is searched for all of them at once, and two
occurrences at a distance that fits the size are a seed: the words to the left and
right are compared at that distance until they differ. A seed inside a known run whose
period divides the distance is left out, as it leads to that run or a multiple of it.

A block is at most four numbers, each of which names a quarter of it, since the
automaton follows its failure links to their end at each step. Numbers are written as
digits to a base of 64, the first of them marked, since a node looks through its
children one by one. Blocks with a word that does not come again within the largest
distance of their size are no keys, which leaves next to none in plain prose; nor are
blocks that only come again within one known run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, take

#: Words that a run has at least.
LEAST = 12
#: Words are written as digits to this base; the first digit is larger by it.
DIGITS = 64


def bands(longest: int, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(size, low, high): runs of these periods hold an aligned block of that size and its copy one period later.

    A run of period q has max(least, 2 q) words or more, so the first of two equal blocks may lie
    in max(least - q, q) words, and an aligned one of `size` words fits into any 2 size - 1.
    """
    fits = lambda q: 1 << ((max(least - q, q) + 1) // 2).bit_length() - 1
    low = 1
    while low <= longest:
        size, high = fits(low), low
        if low >= least:
            high = 4 * size - 2
        while high < longest and fits(high + 1) == size:
            high += 1
        yield size, low, min(high, longest)
        low = high + 1


def numbered(words: list) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and the distance to its next occurrence (the number of words, if there is none)."""
    n = len(words)
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    ahead = np.full(n, n, np.int64)
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return ids, ahead


def digits(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """The digits of all ids, one word after another, and how many a word has."""
    width = 1
    while DIGITS**width <= (int(ids.max()) if len(ids) else 0):
        width += 1
    out = np.stack([ids // DIGITS**k % DIGITS for k in range(width)], axis=1)
    out[:, 0] += DIGITS
    return out.ravel(), width


def _alike(ids: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from `at` on, in steps of 1 or -1, equal those at a distance."""
    most = len(ids) - at - distance if step > 0 else at + 1
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        a = at + done if step > 0 else at - done - size + 1
        differ = np.flatnonzero(ids[a : a + size] != ids[a + distance : a + distance + size])
        if len(differ):
            return done + (int(differ[0]) if step > 0 else size - 1 - int(differ[-1]))
        done, size = done + size, 4 * size
    return done


def _occurrences(names: np.ndarray, unit: int, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at which the blocks that start at the words `keys` occur, and which distinct block that is; by block, then place.

    names has a number for the `unit` words from each word on. A sequence for each remainder of a
    place by `unit`, one after another and with an end mark each, holds every block as at most four numbers.
    """
    rows = len(names) // unit + 2
    places = np.arange(rows * unit).reshape(rows, unit).T.ravel()
    there = places < len(names)
    plain, width = digits(np.where(there, names[np.where(there, places, 0)], names.max() + 1))
    sequence, long = tuple(plain.tolist()), size // unit
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, at in enumerate((keys // unit).tolist()):
        automaton.add_word(sequence[at * width : (at + long) * width], number)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(sequence) for x in hit), np.int64).reshape(-1, 2)
    starts, blocks = places[(hits[:, 0] + 1) // width - long], hits[:, 1]
    order = np.lexsort((starts, blocks))
    return starts[order], blocks[order]


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of `least` words or more as (start, length, period), by start, then period."""
    n = len(words)
    if n < least:
        return []
    ids, ahead = numbered(words)
    if (ahead == n).all():
        return []
    once = np.bincount(ids)[ids] == 1
    plain = np.unique(np.where(once, -1, ids), return_inverse=True)[1]  # words that occur once are in no key and share a number
    names, unit = plain, 1
    found: list[tuple[int, int, int]] = []
    for size, low, high in bands(n // 2, least):
        keys = np.arange(0, n - size - low + 1, size)
        keys = keys[ahead[: len(keys) * size].reshape(-1, size).max(axis=1) <= high]
        known = sorted((s, s + m, q) for s, m, q in found if m >= size)
        for s, e, q in known:
            if q <= size and len(keys):  # in a run, a block as long as its period comes again at multiples of it only
                keys = keys[(keys < s) | (np.minimum(keys + high + size, n) > e)]
        if not len(keys):
            continue
        if unit > max(1, size // 4):
            names, unit = plain, 1
        while unit < size // 4:
            pairs = names[: len(names) - unit] * (int(names.max()) + 1) + names[unit:]
            names, unit = np.unique(pairs, return_inverse=True)[1], 2 * unit
        _seeds(ids, *_occurrences(names, unit, size, keys), keys, (size, low, high), known, least, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _seeds(ids: np.ndarray, starts: np.ndarray, blocks: np.ndarray, keys: np.ndarray, band: tuple[int, int, int], known: list, least: int, found: list) -> None:
    """Appends the runs that two occurrences of a block at a fitting distance lead to."""
    size, low, high = band
    alike: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for period in {q for _, _, q in known if 2 * q <= size}:
        alike[period] = tuple(np.array(x) for x in zip(*[(s, e) for s, e, q in known if q == period], strict=True))
    first = np.searchsorted(blocks, np.arange(len(keys) + 1))
    chosen = np.flatnonzero(np.isin(starts, keys))
    around: list[tuple[int, int, int]] = []  # runs that may hold the next block: (end, start, period)
    taken = 0
    for i in chosen[np.argsort(starts[chosen], kind="stable")].tolist():
        at, block = int(starts[i]), int(blocks[i])
        while taken < len(known) and known[taken][0] <= at:
            s, e, q = known[taken]
            around.append((e, s, q))
            taken += 1
        around = [r for r in around if r[0] >= at + size]
        later = starts[i + 1 : first[block + 1]]
        distances = later[np.searchsorted(later, at + low) : np.searchsorted(later, at + high, "right")] - at
        for e, s, q in around:
            if len(distances) and s <= at:
                distances = distances[(distances % q != 0) | (distances > e - at - size)]
                if q in alike:
                    distances = distances[~_apart(at, size, distances, s, e, *alike[q])]
        while len(distances):
            d = int(distances[0])
            s, e = at - _alike(ids, at - 1, d, -1), at + size + _alike(ids, at + size, d, 1) + d
            distances = distances[1:]
            if e - s >= max(least, 2 * d):
                found.append((s, e - s, d))
                around.append((e, s, d))
                distances = distances[(distances % d != 0) | (distances > e - at - size)]


def _apart(at: int, size: int, distances: np.ndarray, start: int, end: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which distances lead from a block in a run to one in another run of that period, with less than a distance's words alike.

    Two such runs, in step, are alike from the later of their starts to the earlier of
    their ends; if they start or end together, more may be alike, and nothing is said.
    """
    other = np.maximum(np.searchsorted(starts, at + distances, "right") - 1, 0)
    s, e = starts[other] - distances, ends[other] - distances
    inside = (s <= at) & (e >= at + size) & (s != start) & (e != end)
    return inside & (np.minimum(e, end) - np.maximum(s, start) < distances)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """A mask of the words that stay if of each run only its first period does."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


FOUND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic(df: DataFrame, text: str = "text", into: str = "runs", least: int = LEAST) -> DataFrame:
    """df with its runs: an array of start (word number), length and period, by start, then period.

    Null, empty and short texts have none; whole texts are searched, however long; repeated
    rows are rows each; other columns stay, but for one named like `into`, which is replaced.
    """
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    @F.arrow_udf(FOUND)
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs(_words(t), least)] for t in texts.to_pylist()], kind)

    return df.withColumn(into, made(F.col(text).cast("binary")))


def collapsed(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with each run cut to its first period, words joined by one space; a null text stays null. Bytes that are no UTF-8 become U+FFFD."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _joined(_words(t), runs(_words(t), least)).decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    return df.withColumn(text, made(F.col(text).cast("binary")))


def _joined(words: list[bytes], found: list) -> bytes:
    return b" ".join([w for w, stays in zip(words, kept(len(words), found), strict=True) if stays]) if found else b" ".join(words)


def planted(words: list, number: int | None) -> list:
    """The words with a period planted into those of every tenth number, a CRC of the id; fixed by the contract."""
    n = len(words)
    if number is None or number % 10 or not n:
        return words
    g = number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


DIGEST = "struct<n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,runs_sha256:string,collapsed_sha256:string>"


def _digest(text: bytes | None, number: int | None) -> dict:
    words = planted(_words(text), number)
    found = runs(words)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return {
        "n_runs": len(found), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if found else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(_joined(words, found)).hexdigest(),
    }


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_runs, the longest run (nulls if there is none) and digests of all runs and of the words that stay, after planting.

    A null or empty text has no words and no runs; a null key plants nothing and stays null; ties of
    length go by start, then period; repeated rows are rows each; an empty table gives an empty
    one; other columns are dropped. Whole texts are searched, however long, one size of block at a time.
    """
    small_batches(df.sparkSession)
    own = take(df, key, text)
    kind = pa.struct([*((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    @F.arrow_udf(DIGEST)
    def made(keys: pa.Array, texts: pa.Array) -> pa.Array:
        numbers = [None if k is None else zlib.crc32(k.encode()) for k in keys.to_pylist()]
        return pa.array([_digest(t, k) for k, t in zip(numbers, texts.to_pylist(), strict=True)], kind)

    return own.select(key, made(own[key].cast("string"), own[text].cast("binary")).alias("found")).select(key, "found.*")
