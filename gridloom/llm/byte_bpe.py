"""Byte-level BPE by monoid tree reduction.

A pre-token that isn't itself a token is halved until a half is one byte, halves are
encoded, and neighbours are joined. Two neighbours whose tokens at the seam are
compatible (the two, encoded together, are those two) are put side by side. Else a
window at the seam is encoded anew: the last k tokens of the left and the first k of
the right. The join stops when the pairs at the window's two ends are compatible, else
k doubles.

Why that is exact: take tokens in which every adjacent pair is compatible, and
suppose merging all their bytes by rank (leftmost first) ever merges across an end
of a token. Up to the first such merge, what happened within the two tokens at
that end is what happens when the two are encoded alone, so they would merge
across it there too, against compatibility. So nothing crosses, and each token is
rebuilt from its bytes: the sequence is the encoding. Inside the old left and
right parts and inside the window all pairs are compatible already.

Texts are split by the pattern first, and no merge crosses its matches, so texts
are concatenations of pre-tokens: the top of the tree. Decoding concatenates.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, fresh, table

#: Pre-tokens, pieces and pairs that a task remembers; beyond, it starts afresh. Longer ones are encoded each time.
REMEMBERED, REMEMBERED_BYTES, WINDOW_BYTES = 100_000, 64, 6


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Merges the lowest-ranked adjacent pair, leftmost first, until no pair is a token."""
    parts, get, none = [piece[k : k + 1] for k in range(len(piece))], ranks.get, 1 << 60
    pairs = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != none:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


@lru_cache(2)
def irregular_tokens(path: str) -> frozenset[bytes]:
    """Tokens that merging their own bytes doesn't give; only as whole pre-tokens do they stand for themselves."""
    ranks = load_ranks(path)
    return frozenset(t for t, r in ranks.items() if len(t) > 1 and merge(ranks, t) != [r])


class Encoder:
    """Texts to ids and back. ``joins`` counts the joins of the tree."""

    def __init__(self, path: str, pattern: str, irregular: frozenset[bytes]):
        import regex

        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.irregular, self.joins = irregular, 0
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """A window's ids; windows come back often."""
        found = self.pieces.get(piece)
        if found is None:
            rank = self.ranks.get(piece)
            found = (rank,) if rank is not None and piece not in self.irregular else tuple(merge(self.ranks, piece))
            self.remember(piece, found)
        return found

    def remember(self, piece: bytes, ids: tuple[int, ...]) -> None:
        if len(piece) <= WINDOW_BYTES:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = ids

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == (a, b)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        self.joins += 1
        if self.compatible(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.merged(b"".join(map(self.tokens.__getitem__, a + b)))
            if (len(a) == len(left) or self.compatible(left[-k - 1], window[0])) and (len(b) == len(right) or self.compatible(window[-1], right[k])):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, piece: bytes) -> tuple[int, ...]:
        """Both halves' ids, joined; short pieces are reduced once."""
        size = len(piece)
        if size == 1:
            return (self.ranks[piece],)
        found = self.pieces.get(piece)
        if found is None:
            half = size // 2
            left, right = self.tree(piece[:half]), self.tree(piece[half:])
            if self.pairs.get((left[-1], right[0])):  # known to be compatible
                self.joins += 1
                found = left + right
            else:
                found = self.join(left, right)
            if size <= WINDOW_BYTES:
                self.remember(piece, found)
        return found

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else self.tree(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's own encoder, which remembers pieces from task to task."""
    return Encoder(path, pattern, irregular_tokens(path))


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _pieces(batch: pa.RecordBatch, rows: int = 256):
    """Smaller batches, so that what a task builds at once stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The columns of ``docs`` without the text, and n_tokens and ``ids_col``: ids as little-endian unsigned 32-bit integers.

    Null or empty text has no ids. Rows of any ids, repeated ones too, are
    encoded alike. ``ranks`` is a path on every machine. A column of ``docs``
    named as a result is replaced, other names can't clash. A text must fit a Python
    worker, with its ids; the tree needs its depth, the logarithm of a pre-token's bytes.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens", ids_col)]
    text = fresh(docs.columns, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))

    def run(batches):
        own = encoder(ranks, pattern)
        for batch in batches:
            for part in _pieces(batch):
                ids = [own.encode(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array([len(i) // 4 for i in ids], pa.int64()), _binary(ids)], [*kept, "n_tokens", ids_col])

    schema = rows.drop(text).schema.add("n_tokens", "long").add(ids_col, "binary")
    return rows.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and ``out_col``: the bytes that its ids stand for. Null ids decode to no bytes."""

    def run(batches):
        table_ = load_ranks(ranks)
        tokens = [b""] * (max(table_.values()) + 1)
        for token, rank in table_.items():
            tokens[rank] = token
        for batch in batches:
            for part in _pieces(batch):
                out = [b"".join(map(tokens.__getitem__, np.frombuffer(i or b"", "<u4").tolist())) for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(out)], [*part.schema.names, out_col])

    return encoded.mapInArrow(run, encoded.drop(out_col).schema.add(out_col, "binary")) if out_col not in encoded.columns else bpe_decode(encoded.drop(out_col), ranks, ids_col=ids_col, out_col=out_col)


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """What bpe_decode() gives for bpe_encode(), by one Python worker a task: two in a row each hold batches and tables at the same time."""
    bounded_batches(docs.sparkSession)
    made = ["n_tokens", ids_col, out_col]
    kept = [c for c in docs.columns if c not in (text_col, *made)]
    text = fresh(docs.columns, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))

    def run(batches):
        own = encoder(ranks, pattern)
        for batch in batches:
            for part in _pieces(batch):
                ids = [own.encode(t) for t in part.column(text).to_pylist()]
                out = [pa.array([len(i) // 4 for i in ids], pa.int64()), _binary(ids), _binary([own.decode(i) for i in ids])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + out, [*kept, *made])

    return rows.mapInArrow(run, rows.drop(text).schema.add("n_tokens", "long").add(ids_col, "binary").add(out_col, "binary"))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    back = bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
