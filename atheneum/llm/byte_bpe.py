"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
the tokens that end at each place. A sequence of tokens is what merging by rank gives if, and only if, each two
neighbours are: merging the bytes of both again gives the same two tokens. The encoder walks the piece from the
left with the longest token that fits, falls back to the token's next shorter prefix when a neighbour doesn't fit,
and steps back when no prefix is left; a place found to be a dead end is never tried again, so the work is linear in
the piece. Whether two tokens may stand side by side is computed once and remembered.

Cases: a null or empty text has no tokens; a piece that is a token itself is that token; texts of any length are
encoded whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Distinct pieces whose encoding a worker remembers, beyond which the memory is emptied, and the longest that are.
MEMO_PIECES, MEMO_CHARS = 150_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self._shorter:
            whole = self.tokens[token]
            self._shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), None)
        return self._shorter[token]

    def merged(self, piece: bytes) -> list[int]:
        """Merging by rank, one merge after the other: only for two tokens at a time, which are short."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, -1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between the two tokens."""
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return self._fits[key]

    def longest_from(self, piece: bytes) -> list[int]:
        """For each place, the longest token that begins there: of those found, the one that ends last."""
        best = [-1] * len(piece)
        for end, (before, token) in self.automaton.iter(piece.decode("latin-1")):
            best[end - before] = token
        return best

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest, open_, out, at = self.longest_from(piece), bytearray(b"\1") * (len(piece) + 1), [], 0
        token: int | None = longest[0]
        while at < len(piece):
            while token is not None:
                end = at + len(self.tokens[token])
                if open_[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter(token)
            if token is None:  # nothing leads on from here: take the last token back and try a shorter one there
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                token = out.pop()
                at -= len(self.tokens[token])
                continue
            out.append(token)
            at = end
            token = longest[at] if at < len(piece) else None
        return out

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.pattern.findall(text) for t in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """Loaded once per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[path, pattern]


class Memo(dict):
    """What ``make`` gives for a piece, computed when first asked for; emptied when MEMO_PIECES are held."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        out = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, empty for a null text) and ``decoded`` (binary, from the ids) added."""
    docs = docs.drop("ids", "decoded")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("binary").alias("decoded")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        ids_of = Memo(lambda piece: bpe.encode_piece(piece.encode()))
        for batch in slices(batches):
            ids = [list(chain.from_iterable(map(ids_of.__getitem__, bpe.pattern.findall(text or "")))) for text in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())], names=[*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(tidy(encode), schema)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as ``encode_column``, without handing the ids over."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)

        def both(piece: str) -> tuple[str, bytes]:
            ids = bpe.encode_piece(piece.encode())
            return " ".join(map(str, ids)), bpe.decode(ids)

        memo = Memo(both)
        for batch in slices(batches):
            n, ids_sum, decoded_sum = [], [], []
            for text in batch.column("text").to_pylist():
                got = list(map(memo.__getitem__, bpe.pattern.findall(text or "")))
                ids = " ".join([x[0] for x in got])
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sum.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sum.append(hashlib.sha256(b"".join([x[1] for x in got])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(decoded_sum, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(encode), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
