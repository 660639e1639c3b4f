"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece, BPE has exactly one encoding, and so exactly one last token.
The encoder stores these last tokens. The last token of a prefix is the one vocabulary
entry that ends there, whose rest is a prefix already solved, and which is compatible with
that rest's own last token: two tokens are compatible when BPE leaves their joint bytes as
these two. Walking back from the end gives the encoding in linear time for any length of
piece. As a stored entry depends on nothing behind it, bytes can be appended exactly, and
after an edit only the entries near it are computed anew.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Pieces whose encoding a worker remembers, and token pairs whose compatibility it does.
REMEMBERED_PIECES = 600_000
REMEMBERED_PAIRS = 1_000_000

#: Texts longer than this many characters are split into pieces a part at a time.
WHOLE_CHARS = 1 << 20

#: Bytes of output that are gathered before they are sent on.
FLUSH_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encodes pieces of bytes; safe for any length of piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        tails: dict[bytes, int] = {}
        for token in ranks:
            for k in range(len(token)):
                tails.setdefault(token[k:], -1)
        tails.update(ranks)
        self._tails = tails
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: join the adjacent pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (last[i]: the last token of data[:i], last[0] unused) up to the end of data."""
        if not last:
            last.append(-1)
        for end in range(len(last), len(data) + 1):
            last.append(self._last_at(data, end, last))
        return last

    def _last_at(self, data: bytes, end: int, last: list[int]) -> int:
        tails, pairs = self._tails, self._pairs
        for start in range(end - 1, -1, -1):
            rank = tails.get(data[start:end])
            if rank is None:
                break
            if rank >= 0:
                if not start:
                    return rank
                known = pairs.get((last[start], rank))
                if known or known is None and self.compatible(last[start], rank):
                    return rank
        raise ValueError("the vocabulary has no token for a byte")

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk_back(self.extend(data, []))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceEncoding:
    """One piece with its stored prefix tokens: exact appends, and re-encoding near an edit."""

    def __init__(self, bpe: ByteBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last)
        self.computed = len(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)
        self.computed = len(more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]. Entries before the edit stay; behind it they are computed
        until as many in a row as the longest token agree with the old ones, which then hold on."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, agreed, at = old[: start + 1], 0, start
        while at < len(self.data):
            at += 1
            last.append(self.bpe._last_at(self.data, at, last))
            behind = at - shift
            agreed = agreed + 1 if at > start + len(new) and last[at] == old[behind] else 0
            if agreed >= self.bpe.longest:
                last += old[behind + 1 :]
                break
        self.computed = at - start
        self.last = last

    def ids(self) -> list[int]:
        return self.bpe.walk_back(self.last)


class TextEncoder(dict):
    """Encodes whole texts; remembers the encoding of each piece as little-endian 32-bit ids."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        self.bpe = ByteBPE(load_ranks(ranks_path))
        self.token_table = pa.array([self.bpe.tokens.get(i, b"") for i in range(max(self.bpe.tokens) + 1)], pa.binary())
        # The library's \s is the property White_Space; this one's would add four control characters.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) <= WHOLE_CHARS:
            return b"".join(map(self.__getitem__, self.pieces.findall(text)))
        found, out = (m[0] for m in self.pieces.finditer(text)), []
        while part := list(islice(found, 100_000)):
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> TextEncoder:
    return TextEncoder(ranks_path, pattern)


def _convert(name: str, into: str, function, kind: pa.DataType):
    """A batch function that adds column ``into``, made by ``function`` from column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            at, values, size = 0, [], 0
            column = batch.column(batch.schema.get_field_index(name))
            schema = pa.schema([*batch.schema, pa.field(into, kind)])
            for i in range(batch.num_rows):
                values.append(apply(column[i].as_py()))
                size += len(values[-1])
                if size >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], schema=schema)
                    at, values, size = i + 1, [], 0

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with column ``into``: binary, the ids of the whole text as little-endian unsigned 32-bit.

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty
    text give no ids. All columns stay; ``into`` must not name one of them. Rows are treated
    one by one, so ties, repeated rows and an empty table need no rule.
    """
    if into in docs.columns:
        raise ValueError(f"the documents have a column {into} already")

    def make():
        encode = encoder(ranks_path, pattern).encode
        return lambda text: encode(text or "")

    return map_batches(docs, _convert(text_col, into, make, pa.binary()), f"{_schema(docs)}, `{into}` binary")


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with column ``into``: the bytes that the ids of ``ids_col`` stand for; null gives none."""
    if into in df.columns:
        raise ValueError(f"the table has a column {into} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(ranks_path, pattern).token_table
        for batch in batches:
            ids = pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)), b"")
            bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[bounds[0] // 4 : bounds[-1] // 4]
            # Taking the tokens of all ids puts their bytes in one buffer, which the texts' bounds divide.
            taken = tokens.take(pa.array(flat))
            ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
            offsets = np.ascontiguousarray(ends[(bounds - bounds[0]) // 4])
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), taken.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], schema=pa.schema([*batch.schema, pa.field(into, pa.binary())]))

    return map_batches(df, run, f"{_schema(df)}, `{into}` binary")
