"""Operator 10: byte-level BPE by longest matches and backtracking.

A sequence of tokens is the BPE encoding of its bytes exactly if each token and
its right neighbour are together the encoding of theirs. So a piece is covered
from the left with the longest token that starts there; where that token is not
compatible with its left neighbour, the next shorter one is tried; where none is
left, the neighbour is taken back and its end marked as dead, for the encoding of
a prefix is unique. Each place of the piece is entered once, and each token has a
bounded number of shorter ones, hence linear time.

Longest matches come from an Aho-Corasick automaton over the vocabulary, whose
bytes are mapped to Latin-1 characters. Compatibility of a pair is found once,
and remembered: the last merges of the two tokens are undone, latest first, and
at no point may the parts that then meet have a merge that comes before the one
that was undone.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import plain, small_batches, take

#: Pieces, and pairs, remembered by each Python worker: the last ones used, up to twice as many.
REMEMBERED = 100_000
#: Longer pieces are not remembered.
LONG_PIECE = 64


class ByteBPE:
    """A vocabulary of byte strings with ranks, and the pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.digits = {i: str(i) for i in self.token}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.old_pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.size = {i: len(b) for b, i in ranks.items()}
        #: The longest token that is a proper prefix of a token; -1 if there is none.
        self.shorter_of = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b, i in ranks.items()}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined. For a few bytes only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins; a byte is both halves of itself; None if merging never yields the token."""
        known = self.halves.get(token, 0)
        if known == 0:
            data = self.token[token]
            known = (token, token) if len(data) == 1 else None
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                if len(parts) == 2:
                    known = (self.ranks[parts[0]], self.ranks[parts[1]])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        if self.last_merge(left) is None or self.last_merge(right) is None:
            return False
        ranks, token, limit = self.ranks, self.token, 1 << 60
        while True:
            if ranks.get(token[left] + token[right], 1 << 60) < limit:
                return False
            whole_left, whole_right = len(token[left]) == 1, len(token[right]) == 1
            if whole_left and whole_right:
                return True
            if whole_right or not whole_left and left > right:
                limit, left = left, self.last_merge(left)[1]
            else:  # of equal ranks the left one is merged first
                limit, right = right + 1, self.last_merge(right)[0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.old_pairs.get((left, right))
            if known is None:
                known = self._compatible(left, right)
            if len(self.pairs) >= REMEMBERED:
                self.old_pairs, self.pairs = self.pairs, {}
            self.pairs[left, right] = known
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The tokens of a piece. A piece that is a token itself is that token, whatever the merges say."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n, size, known = len(data), self.size, self.pairs.get
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends ascend, so the last one set is the longest
        dead = bytearray(n + 1)
        found: list[int] = []
        at, token, left = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    fits = left < 0 or known((left, token))
                    if fits is None:
                        fits = self.compatible(left, token)
                        known = self.pairs.get
                    if fits:
                        break
                token = self.shorter_of[token]
            if token >= 0:
                found.append(token)
                at += size[token]
                left = token
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = found.pop()
                at -= size[token]
                left = found[-1] if found else -1
                token = self.shorter_of[token]
        return tuple(found)

    def encode(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        new = set(pieces).difference(self.pieces)
        if new and len(self.pieces) + len(new) > REMEMBERED:
            self.old_pieces, self.pieces = self.pieces, {}
            new = set(pieces)
        old = self.old_pieces.get
        for p in new:
            self.pieces[p] = old(p) or self.piece(p.encode("utf-8"))
        ids = list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        for p in new:
            if len(p) > LONG_PIECE:
                del self.pieces[p]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64, a blank and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_held: dict[str, ByteBPE] = {}


def held(data: bytes, pattern: str) -> ByteBPE:
    """The tokenizer of a rank file, built once in each Python worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = ByteBPE(read_ranks(data), pattern)
    return _held[key]


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def _added(df: DataFrame, udf, column: str, into: str) -> DataFrame:
    """df with udf of a column; columns that have the name into already, in any case, are left out."""
    small_batches(df.sparkSession)
    wide, (at,) = plain(df, column)
    kept = [(c, n) for c, n in zip(wide.columns, df.columns, strict=True) if n.lower() != into.lower()]
    return wide.select(*[c for c, _ in kept], udf(wide[at]).alias("made")).toDF(*[n for _, n in kept], into)


def plain_text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of a text column (null: as an empty text) as an array of int.

    A column that already has the name `into`, in any case, is replaced. Bytes that are
    not UTF-8 count as U+FFFD; repeated rows are encoded each; an empty table gives an
    empty one.
    """
    data = _vocabulary(df, path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe = held(data.value, pattern)
        return pa.array([bpe.encode(plain_text(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return _added(df, lambda c: ids(c.cast("binary")), text, into)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of an id column; bytes that are no UTF-8 become U+FFFD. Null ids give null, no ids an empty text; an empty table gives an empty one."""
    data = _vocabulary(df, path)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        bpe = held(data.value, pattern)
        return pa.array([None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return _added(df, texts, ids, into)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, the number of tokens, the SHA-256 of the ids and of the bytes they decode to.

    Null and empty texts have no tokens; bytes that are not UTF-8 count as U+FFFD;
    repeated rows give repeated rows; a null key stays null; an empty table gives an empty one; other columns are dropped.
    """
    data = _vocabulary(df, path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe = held(data.value, pattern)
        out = []
        for t in texts.to_pylist():
            ids = bpe.encode(plain_text(t))
            decimal = ",".join(map(bpe.digits.__getitem__, ids))
            out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(decimal.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest()})
        return pa.array(out, DIGEST)

    small_batches(df.sparkSession)
    own = take(df, key, text)
    return own.select(key, digests(own[text].cast("binary")).alias("digest")).select(key, "digest.*")
