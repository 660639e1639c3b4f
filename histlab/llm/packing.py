"""Packing by concatenating and cutting: two-pass prefix sums and fixed windows.

The first pass turns every text into token ids and writes them with the running total
inside their partition. The second sums the totals of the partitions to global offsets.
Every document then knows where it lies in the concatenation of all documents, and cuts
itself at the multiples of the window; what a document has in a window is one record, so a
document that crosses a boundary has a record on both sides. Only the last window has room
left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, materialize

WINDOW = 2048
END_ID = 1

#: Words whose ids a worker remembers, and stems of words; beyond, only those of the latest texts stay.
REMEMBERED_WORDS = 150_000
REMEMBERED_STEMS = 150_000

#: Bytes of text that are encoded together and sent on.
FLUSH_BYTES = 3 << 20

#: A word of letters with marks behind it, which the tokenizer takes apart at just that place.
_PLAIN = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")

#: The start of a special token, or a mark that can join with a letter before it.
_AS_IT_IS = r"<\||[\x{300}-\x{36f}]"
#: A letter and the marks behind it, which the tokenizer takes apart in any case.
_MARKED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte but the space."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others) if b != 32}


class WordEncoder:
    """Encodes word by word with a cache, for tokenizers that drop white space and case.

    The ids of a text are then those of its words in turn: no pre-token, special token or
    composed character crosses ASCII white space. Words of lower-case letters in composed
    form need no normalising; what is new of them goes to the tokenizer's model together,
    and is told apart by the tokens that end a word. All other words go to the whole
    tokenizer one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # the same model in memory
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {b"": b""}
        self.stems: dict[bytes, bytes] = {b"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, stems: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are lower-case letters only and in composed form."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(stems), 2000):
            part = stems[at : at + 2000]
            line = b" ".join(part).decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode(line, add_special_tokens=False).ids, "<u4")
            data, start = ids.tobytes(), 0
            for stem, stop in zip(part, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                out[stem] = data[start:stop]
                start = stop
        return out

    def _add(self, words: list[bytes]) -> None:
        """Remember words that are new."""
        known, stems, plain, fresh = self.words, self.stems, [], set()
        for word in words:
            m = _PLAIN.fullmatch(word) if len(word) <= 64 else None
            if m and (word.isascii() or ((s := m[1].decode()).isalpha() and s.islower() and s == s.lower() and is_normalized("NFC", s))):
                stem, marks = m.groups()
                plain.append((word, stem, marks))
                if stem not in stems:
                    fresh.add(stem)
                if marks not in stems:
                    stems[marks] = self._ids(marks.decode())
            else:
                known[word] = self._ids(word.decode())
        stems |= self._learn(list(fresh))
        for word, stem, marks in plain:
            known[word] = stems[stem] + stems[marks] if marks else stems[stem]
        if len(stems) > REMEMBERED_STEMS:
            self.stems = {b"": b""} | {stem: stems[stem] for _, stem, _ in plain}

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit; and their numbers."""
        # A space before marks and lower-case A-Z change no id, unless that makes or breaks a
        # special token, or a composed letter.
        simple = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKED, r"\1 \2")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _AS_IT_IS), texts, simple))
        coded = pc.list_flatten(split).dictionary_encode()
        met, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        known = self.words
        self._add([word for word in met if word not in known])
        ids = list(map(known.__getitem__, met))
        if len(known) > REMEMBERED_WORDS:
            self.words = {b"": b""} | dict(zip(met, ids, strict=True))
        # The end id counts as one more word of each text; taking the words' ids puts them in one buffer.
        ids.append(np.array([end_id], "<u4").tobytes())
        stops = np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64))
        taken = pa.array(ids, pa.binary()).take(pa.array(np.insert(codes, stops, len(ids) - 1)))
        bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
        offsets = bounds[np.concatenate(([0], stops + np.arange(1, len(texts) + 1)))]
        packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), taken.buffers()[2]])
        return packed, np.diff(offsets.astype(np.int64)) // 4


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about FLUSH_BYTES, or of one row if that is longer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = 0
        for i, length in enumerate(lengths.tolist()):
            size += length
            if size >= FLUSH_BYTES:
                yield pa.concat_batches([*held, batch.slice(at, i + 1 - at)])
                held, size, at = [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def tokens_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """First pass: part, before (ids before the document in its part), id, n, ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for got in _parts(batches):
            ids, counts = encoder.encode_all(pc.fill_null(got.column(1).cast(pa.string()), ""), end_id)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            arrays = [pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), got.column(0), pa.array(counts), ids]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "before", "id", "n", "ids"])

    return map_batches(docs.select(id_col, text_col), run, f"part int, before long, id {kind}, n long, ids binary")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass over a stored table of tokens_of(): one row per document and window."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task that read documents, so the window below stays small.
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    bases = broadcast_if_small(materialize(bases, "pack-bases"))
    placed = tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("before"))
    at, n, w = F.col("at"), F.col("n"), F.lit(window).cast("long")

    def piece(k):
        start = F.greatest(k * w - at, F.lit(0))
        end = F.least((k + 1) * w - at, n)
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.struct(
            start.alias("start"),
            (end - start).alias("length"),
            F.crc32(ids).alias("ids_crc32"),
            k.alias("sequence_id"),
            (at + start - k * w).alias("offset"),
            ids.alias("ids"),
        )

    windows = F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + n - 1) div {window}"))
    return placed.select("id", F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p")).select("id", "doc_tokens", "p.*")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack all documents into windows; one row per piece of a document.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (binary,
    little-endian unsigned 32-bit). A null or empty text is its end id alone. Rows with equal
    ids are separate documents; null ids stay null. Only the two columns named are read, so
    other columns cannot clash. An empty table gives no pieces.
    """
    tokens = materialize(tokens_of(docs, tokenizer_path, id_col, text_col, end_id), "pack-tokens")
    out = cut(tokens, window)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
