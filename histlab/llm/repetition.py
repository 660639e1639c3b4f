"""Quality rules with suffix-array repetition.

The texts of a batch are put together as one sequence, each text told apart from the others,
so one suffix array serves them all and no repeat spans two texts. Ranks of prefixes
(prefix doubling, sorting only what is not told apart yet) give the suffix array, and, from
the longest down, the longest common prefix of neighbours. The deepest LCP interval that
holds a suffix is the longest maximal repeat that starts there; the union of these spans is
what a text repeats. A text is kept if the repeated share and the longest repeat stay within
limits.

Repeated windows are counted over words. Repeats are of characters, so they do not depend on
how long words are: the array is over bytes, with one blank between words that has no size,
and spans are cut to whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: A repeat counts from this many bytes of words.
MIN_REPEAT_BYTES = 30
MAX_COVERED = 0.3
MAX_LONGEST_BYTES = 2000

#: Words that are measured together, and bytes and texts that share one suffix array; a longer text has one of its own.
BATCH_TOKENS = 150_000
BATCH_BYTES, BATCH_TEXTS = 150_000, 30_000
#: Bytes by which suffixes are sorted at first.
FIRST_BYTES = 6

#: From this many bytes on, prefix lengths are found one by one, in less memory.
LARGE_TOKENS = 1 << 20


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class Sequence:
    """Texts as one array: token numbers, then a separator after each text.

    The numbers of each text are its own, so nothing in one text equals anything in another.
    """

    def __init__(self, texts: list[list[bytes]]):
        numbers = _Numbers()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(counts.sum())
        flat = np.fromiter((numbers[w] for words in texts for w in words), np.int64, total)
        self.n_texts, self.counts = len(texts), counts
        self.text_of = np.repeat(np.arange(len(texts)), counts + 1)
        ends = np.cumsum(counts + 1) - 1
        self.tokens = self.text_of * (len(numbers) + 1)
        inside = np.ones(total + len(texts), bool)
        inside[ends] = False
        self.tokens[inside] += flat
        self.tokens[ends] += len(numbers)

    def repeated_windows(self, levels: list[np.ndarray], width: int = WINDOW_WORDS) -> np.ndarray:
        """Per text: tokens in windows of ``width`` (four tokens and more) that the text has twice or more."""
        n = len(self.tokens)
        out = np.zeros(self.n_texts, np.int64)
        if n < width:
            return out
        # Rank by four tokens; all levels agree from where the suffixes are told apart.
        four = levels[min(2, len(levels) - 1)].astype(np.int64)
        starts = np.flatnonzero(self.text_of[: n - width] == self.text_of[width:]) if n > width else np.zeros(0, np.int64)
        # A window lies inside its text if the place behind it is the separator or a token of that text.
        key = four[starts]
        for k in range(4, width):
            key = key * n + self._first_rank[starts + k]
            _, key = np.unique(key, return_inverse=True)
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        again = starts[count[group] > 1] if len(starts) else starts
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + width, -1)
        return np.bincount(self.text_of, np.cumsum(change[:-1]) > 0, self.n_texts).astype(np.int64)

    def levels(self) -> list[np.ndarray]:
        """Ranks by the first 1, 2 and 4 tokens, or fewer if all suffixes are told apart by less."""
        out = list(islice(_ranks(self.tokens, 1), 3))
        self._first_rank = out[0].astype(np.int64)
        return out


def _ranks(keys: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Ranks of suffixes by the first ``step`` tokens, which ``keys`` stand for, then by twice as
    many and so on, until all are told apart."""
    n = len(keys)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.empty(n, np.int32)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes).astype(np.int32)
    open_ = order[np.repeat(sizes > 1, sizes)]
    yield rank
    while len(open_):
        # A suffix still open goes on for ``step`` tokens at least, so open_ + step is inside.
        a, b = rank[open_].astype(np.int64), rank[open_ + step].astype(np.int64)
        key = a * n + b
        by = np.argsort(key)
        open_, a, key = open_[by], a[by], key[by]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        block_start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        sizes = np.diff(np.append(start, len(open_)))
        group = np.repeat(start, sizes)
        block = np.repeat(block_start, np.diff(np.append(block_start, len(open_))))
        rank = rank.copy()
        rank[open_] = (a + group - block).astype(np.int32)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
        yield rank


class Characters:
    """Texts as one array of bytes, words with a blank between them, then a separator after each text."""

    def __init__(self, texts: list[bytes]):
        # No UTF-8 text holds the byte 255.
        self.data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        self.n_texts = len(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_of = np.repeat(np.arange(len(texts)), lengths)
        self.sizes = ((self.data != 32) & (self.data != 255)).astype(np.int64)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, and the longest common prefix of each suffix with the one before it in its text."""
        n, data = len(self.data), self.data
        padded = np.concatenate((data, np.full(FIRST_BYTES, 255, np.uint8)))
        keys = self.text_of.copy()
        for k in range(FIRST_BYTES):
            keys = (keys << 8) | padded[k : k + n]
        levels: list[np.ndarray] = []
        for rank in _ranks(keys, FIRST_BYTES):
            if n >= LARGE_TOKENS:
                levels.clear()  # only the last one is needed then
            levels.append(rank)
        order = np.empty(n, np.int64)
        order[levels[-1]] = np.arange(n)
        lcp = np.zeros(n, np.int64)
        if n >= LARGE_TOKENS:
            lcp[:] = _lcp_one_by_one((self.text_of << 8) | data, order, levels[-1])
            return order, lcp
        at = np.flatnonzero(self.text_of[order[1:]] == self.text_of[order[:-1]]) + 1
        i, j, length = order[at - 1], order[at], np.zeros(len(at), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            rank = levels[k]
            length += np.where(rank[i + length] == rank[j + length], FIRST_BYTES << k, 0)
        # What is left is shorter than the first prefixes; in one text no two separators meet.
        more = np.arange(len(at))
        for _ in range(FIRST_BYTES - 1):
            more = more[data[i[more] + length[more]] == data[j[more] + length[more]]]
            length[more] += 1
        lcp[at] = length
        return order, lcp

    def repeats(self, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text: bytes within repeats of at least ``min_bytes``, and bytes of the longest repeat."""
        n = len(self.data)
        order, lcp = self.suffixes()
        deepest = np.maximum(lcp, np.append(lcp[1:], 0))
        before = np.concatenate(([0], np.cumsum(self.sizes)))
        inner = (self.data & 0xC0) == 0x80
        if inner.any():  # spans start and stop with characters
            place = np.maximum.accumulate(np.where(inner, 0, np.arange(n)))
            deepest = np.where(inner[order], 0, place[order + deepest] - order)
        size = before[order + deepest] - before[order]
        long = np.flatnonzero((size >= min_bytes) & (deepest > 0))
        starts, stops = order[long], order[long] + deepest[long]
        change = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
        covered = np.where(np.cumsum(change[:-1]) > 0, self.sizes, 0)
        longest = np.zeros(self.n_texts, np.int64)
        np.maximum.at(longest, self.text_of[order], size)
        return np.bincount(self.text_of, covered, self.n_texts).astype(np.int64), longest


def _lcp_one_by_one(tokens: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    s, suffix, place = memoryview(tokens), memoryview(order), memoryview(rank)
    lcp, length, n = np.zeros(len(tokens), np.int64), 0, len(tokens)
    out = memoryview(lcp)
    for i in range(n):
        at = place[i]
        if not at:
            length = 0
            continue
        j = suffix[at - 1]
        while i + length < n and j + length < n and s[i + length] == s[j + length]:
            length += 1
        out[at] = length
        length -= length > 0
    return lcp


def _fine(words: list[bytes]) -> list[bytes]:
    """What repeats are made of: the characters of words, with nothing, as a blank, between words."""
    out: list[bytes] = []
    for k, word in enumerate(words):
        if k:
            out.append(b"")
        out += [c.encode() for c in word.decode()]
    return out


def measure(texts: list[list[bytes]], min_bytes: int = MIN_REPEAT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts as lists of words: repeated words, covered bytes and longest repeat of each."""
    covered, longest = (np.zeros(len(texts), np.int64) for _ in range(2))
    sequence = Sequence(texts)
    repeated = sequence.repeated_windows(sequence.levels())
    own, joined, size = [], [], 0
    for i, words in enumerate(texts):
        if words:
            own.append(i)
            joined.append(b" ".join(words))
            size += len(joined[-1])
        if own and (size >= BATCH_BYTES or len(own) >= BATCH_TEXTS or i + 1 == len(texts)):
            covered[own], longest[own] = Characters(joined).repeats(min_bytes)
            own, joined, size = [], [], 0
    return repeated, covered, longest


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_bytes long, word_bytes long, longest_repeat_bytes long"


def repetition_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_REPEAT_BYTES) -> DataFrame:
    """One row per input row: the id and FIELDS."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, size, texts, rows = batch.column(0), 0, 0, [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                data = text.encode()
                words = data.split()
                lines = [x for x in data.split(b"\n") if x and not x.isspace()] if b"\n" in data else []
                spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
                symbols = sum(data.count(c) for c in SYMBOLS)
                rows.append((len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), len(data) - spaces))
                texts.append(words)
                size += len(words)
                if size >= BATCH_TOKENS or i + 1 == batch.num_rows:
                    repeated, covered, longest = measure(texts, min_bytes)
                    n_words, chars, symbol, dup, bytes_ = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                    arrays = [ids.slice(at, i + 1 - at), *map(pa.array, (n_words, chars, symbol, dup, repeated, covered, bytes_, longest))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])
                    at, size, texts, rows = i + 1, 0, [], []

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {FIELDS}")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_REPEAT_BYTES,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST_BYTES,
) -> DataFrame:
    """One row per input row: id, the measures, covered_share, base_failed and kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in
    repeated windows. kept: not base_failed, the bytes of words within repeats of at least
    ``min_bytes`` are at most ``max_covered`` of all, and the longest repeat has at most
    ``max_longest`` bytes. Null and empty texts have no words and fail. Rows are treated one
    by one, so ties and repeated rows need no rule; only the two columns named are read; an
    empty table gives none.
    """
    from pyspark.sql import functions as F

    stats = repetition_stats(docs, id_col, text_col, min_bytes)
    share = F.when(F.col("word_bytes") > 0, F.col("covered_bytes") / F.col("word_bytes")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumn("covered_share", share).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("covered_share") <= max_covered) & (F.col("longest_repeat_bytes") <= max_longest))
