"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled documents: words, and stems of words, that are much
more frequent in toxic documents. It is kept as a trie. The Levenshtein automaton of the
lexicon's entries is run in step with the trie: a state is a set of trie nodes with the
edits used to reach them, any letter of an entry included. States and moves are made when a
text first needs them and then remembered, so most words fail after a few letters, and
misspelled terms are found at the cost of exact ones. How many edits an entry allows follows
its length, and is less where more than MAX_NEAR words of clean documents are as near. Each hit is judged by the window of tokens around it: quotation marks
and reporting words speak for a quotation, direct address for abuse. A logistic model over
the counts of hits of each sort gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, release

#: Terms of abuse that need no training, as a start.
GENERAL_TERMS = ("dumbass", "idiot", "imbecile", "moron", "scumbag")

#: Bounds of the labelled sample: documents of either label, by the smallest hash of the id.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: Bounds of what the fit takes from the sample: words and stems considered for the lexicon, by
#: toxic documents; and words of clean documents near an entry, by clean documents.
MAX_CANDIDATES, MAX_LOOKALIKES = 600, 100_000
#: So many words of clean documents may be as near to an entry as its edits allow; else it allows fewer.
MAX_NEAR = 25
MIN_DOCS, MIN_SHARE, MIN_LIFT = 3, 0.01, 50.0
STEM_LETTERS = (4, 5, 6, 7)
#: A word that a chosen stem begins is an entry of its own if it is in this share of the stem's documents.
MIN_PART = 0.4
#: A toxic document is told by this many terms at most when the lexicon is chosen.
COVERS = 3

WINDOW = 8
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word slur dit écrit sagte schrieb nannte dijo escribió".split())
DIRECT = frozenset("you your you're vous toi dich usted ustedes".split())

#: Sorts of hits: exact words, stems, misspelled words and stems, those in quotation, those with direct address.
FEATURES = ("exact", "stem", "fuzzy", "fuzzy_stem", "quoted", "direct")
QUOTED, DIRECT_AT = FEATURES.index("quoted"), FEATURES.index("direct")
PRIOR = (-3.0, 4.0, 4.0, 2.0, 1.0, 0.5, 1.0)

#: Words a worker remembers, and moves of the automaton.
REMEMBERED_WORDS = 300_000
REMEMBERED_MOVES = 500_000

_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$", "oieastas")

class Entry(NamedTuple):
    """A term; a stem stands for all words that begin with it."""

    text: str
    stem: bool
    edits: int


def entry(text: str, stem: bool = False) -> Entry:
    """An entry with the edits that its length allows."""
    return Entry(text, stem, 0 if len(text) < 4 else 1 if stem or len(text) < 9 else 2)


class LexiconAutomaton:
    """The lexicon's trie and its entries' Levenshtein automata, run together over a word."""

    def __init__(self, entries: Sequence[Entry]):
        self.entries = list(entries)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.limit = [max((e.edits for e in self.entries), default=0)]
        for number, own in enumerate(self.entries):
            node = 0
            for letter in own.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.limit.append(0)
                node = self.children[node][letter]
                self.limit[node] = max(self.limit[node], own.edits)
            self.ends[node].append(number)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        #: Per state, (edits, entry) of words that end there and of stems, the best first.
        self.words: list[list[tuple[int, int]]] = []
        self.stems: list[list[tuple[int, int]]] = []
        self.moves: dict[tuple[int, str], int] = {}
        start: dict[int, int] = {}
        self._reach(start, 0, 0)
        self._number(start)

    def _reach(self, nodes: dict[int, int], node: int, used: int) -> None:
        if used <= self.limit[node] and used < nodes.get(node, 9):
            nodes[node] = used
            for child in self.children[node].values():  # a letter of the entry is missing
                self._reach(nodes, child, used + 1)

    def _number(self, nodes: dict[int, int]) -> int:
        """The state of these nodes with their fewest edits; 0 is the start, -1 nothing."""
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            ended = sorted((used, e) for node, used in key for e in self.ends[node] if used <= self.entries[e].edits)
            self.words.append([x for x in ended if not self.entries[x[1]].stem])
            self.stems.append([x for x in ended if self.entries[x[1]].stem])
        return number

    def _move(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, used in self.states[state]:
            child = self.children[node].get(letter)
            if child is not None:
                self._reach(nodes, child, used)
            self._reach(nodes, node, used + 1)  # a letter too many
            for child in self.children[node].values():  # another letter
                self._reach(nodes, child, used + 1)
        return self._number(nodes)

    def found(self, word: str) -> Iterator[tuple[int, int]]:
        """All (edits, entry) that the word meets; a stem may come with more edits than it needs, too."""
        if len(self.moves) > REMEMBERED_MOVES:
            self._reset()
        state = 0
        for letter in word:
            key = (state, letter)
            to = self.moves.get(key)
            if to is None:
                to = self.moves[key] = self._move(state, letter)
            if to < 0:
                return
            state = to
            yield from self.stems[state]
        if word:
            yield from self.words[state]

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the entry with the fewest edits, words before stems; or None."""
        best = min(((used, self.entries[e].stem, e) for used, e in self.found(word)), default=None)
        return (best[2], best[0]) if best else None


class Matcher:
    """Finds hits in texts; remembers what it found for a token."""

    def __init__(self, entries: Sequence[Entry], excluded: frozenset[str]):
        self.automaton = LexiconAutomaton(entries)
        self.excluded = excluded
        self.known: dict[str, str] = {}

    def _sort(self, token: str) -> str:
        """The sort of hit that a token is, or nothing."""
        best = ""
        parts = _LETTERS.findall(token)
        if len(parts) != 1 or len(parts[0]) != len(token):
            joined = "".join(_LETTERS.findall(token.translate(_LEET)))
            if sum(map(len, parts)) >= 2:
                parts.append(joined)
        for part in parts:
            found = self.automaton.match(part)
            if found:
                number, edits = found
                if edits and part in self.excluded:
                    continue
                stem = self.automaton.entries[number].stem
                sort = ("fuzzy_stem" if stem else "fuzzy") if edits else "stem" if stem else "exact"
                if not best or FEATURES.index(sort) < FEATURES.index(best):
                    best = sort
        return best

    def hits(self, text: str) -> tuple[list[int], list[str]]:
        """Counts of FEATURES, and the tokens that are hits."""
        tokens, known = text.split(), self.known
        counts, terms = [0] * len(FEATURES), []
        for i, token in enumerate(tokens):
            sort = known.get(token)
            if sort is None:
                sort = self._sort(token.lower())
                if len(token) <= 64:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[token] = sort
            if sort:
                terms.append(token)
                if quotation(tokens, i):
                    counts[QUOTED] += 1
                else:
                    counts[FEATURES.index(sort)] += 1
                    near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                    counts[DIRECT_AT] += any(t.lower().strip(".,;:!?" + QUOTES) in DIRECT for t in near)
        return counts, terms


def quotation(tokens: list[str], i: int) -> bool:
    """Whether token i stands in quotation marks opened and closed within the window, or is
    itself marked and reported."""
    before, behind = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
    opened = False
    for token in before:
        if token[0] in QUOTES:
            opened = True
        if token is not before[-1] and token.rstrip(".,;:!?")[-1:] in tuple(QUOTES) and len(token) > 1:
            opened = False
    if opened and any(t.rstrip(".,;:!?)")[-1:] in tuple(QUOTES) for t in behind):
        return True
    reported = any(t.lower().strip(".,;:!?" + QUOTES) in REPORTING for t in before[-4:-1])
    return reported and (tokens[i][0] in QUOTES or tokens[i].rstrip(".,;:!?")[-1:] in tuple(QUOTES))


@lru_cache(maxsize=2)
def matcher(entries: tuple[Entry, ...], excluded: frozenset[str]) -> Matcher:
    return Matcher(entries, excluded)


# Training.


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Stored (text, label) of at most MAX_TOXIC and MAX_CLEAN labelled documents outside fold 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    part = lambda label, most: known.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
    ids = materialize(part(1, MAX_TOXIC).unionByName(part(0, MAX_CLEAN)), "toxic-ids")
    # At most MAX_TOXIC + MAX_CLEAN ids, so the broadcast is bounded.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    return materialize(rows.where(F.col("text").isNotNull()).select("text", "label").dropDuplicates(), "toxic-sample")


def word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: documents of the sample that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                counts[label.as_py() == 1].update(set(_LETTERS.findall(text.as_py().lower())))
            words = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts[::-1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "toxic", "clean"])

    found = map_batches(sample.select("text", "label"), run, "word string, toxic long, clean long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_lexicon(sample: DataFrame) -> tuple[tuple[Entry, ...], frozenset[str]]:
    """The lexicon, and words of clean documents that only look like misspelled entries."""
    n = {bool(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return tuple(map(entry, GENERAL_TERMS)), frozenset()
    words = materialize(word_counts(sample), "toxic-words")
    few = max(MIN_DOCS, math.ceil(MIN_SHARE * n_toxic))
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    wanted = (F.col("toxic") >= few) & (lift >= MIN_LIFT)
    single = words.where(wanted & (F.length("word") >= 3)).select("word", "toxic", F.lit(False).alias("stem"))
    cuts = F.explode(F.array(*map(F.lit, STEM_LETTERS)))
    stems = words.select("word", "toxic", "clean", cuts.alias("k")).where(F.length("word") > F.col("k"))
    stems = stems.groupBy(F.expr("substring(word, 1, k)").alias("word"))
    stems = stems.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("most"))
    # A stem that one word makes up is that word's.
    stems = stems.where(wanted & (F.col("most") < 0.6 * F.col("toxic"))).select("word", "toxic", F.lit(True).alias("stem"))
    both = single.unionByName(stems).orderBy(F.desc("toxic"), F.length("word"), "word", "stem").limit(MAX_CANDIDATES)
    entries = _cover(sample, [entry(r["word"], r["stem"]) for r in both.collect()])
    have = {e.text for e in entries if not e.stem}
    entries += [entry(t) for t in GENERAL_TERMS if t not in have]
    return _safe(words, entries)


def _cover(sample: DataFrame, candidates: list[Entry]) -> list[Entry]:
    """Take entries, the widest first, while they tell toxic documents not yet told COVERS times."""
    own: dict[str, list[int]] = {}
    for i, e in enumerate(candidates):
        own.setdefault(("s" if e.stem else "w") + e.text, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                found: set[int] = set()
                for word in set(_LETTERS.findall(text.as_py().lower())):
                    found.update(own.get("w" + word, ()))
                    for k in STEM_LETTERS:
                        found.update(own.get("s" + word[:k], ()) if len(word) > k else ())
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["found"])

    toxic = map_batches(sample.where("label = 1").select("text"), run, "found array<int>")
    docs = [r["found"] for r in toxic.collect()]  # at most MAX_TOXIC rows
    holders: dict[int, list[int]] = {}
    for d, found in enumerate(docs):
        for i in found:
            holders.setdefault(i, []).append(d)
    told, chosen, entries = [0] * len(docs), [], []
    least = max(2, len(docs) // 500)
    left = set(holders)
    while left:
        gain, _, i = max((sum(told[d] < COVERS for d in holders[i]), -i, i) for i in left)
        if gain < least:
            break
        left.discard(i)
        own_entry = candidates[i]
        above = [k for k in chosen if candidates[k].stem and own_entry.text.startswith(candidates[k].text)]
        if not above:
            for d in holders[i]:
                told[d] += 1
        # Exact, what a chosen stem begins tells nothing new; an ordinary word of it is an entry for its misspellings.
        if not above or (not own_entry.stem and len(holders[i]) >= MIN_PART * max(len(holders[k]) for k in above)):
            chosen.append(i)
            entries.append(own_entry)
    return entries


def _safe(words: DataFrame, entries: list[Entry]) -> tuple[tuple[Entry, ...], frozenset[str]]:
    """The entries, with fewer edits where clean words are too near; and the clean words near them
    (at most MAX_LOOKALIKES, the most frequent), which are no misspellings."""
    own = tuple(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(own)
        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for word, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                least: dict[int, int] = {}
                for used, e in automaton.found(word):
                    least[e] = min(used, least.get(e, used))
                # A word that an entry matches as it is, is no misspelling of another.
                if least and min(least.values()):
                    rows += [(word, clean, e, used) for e, used in least.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["word", "clean", "entry", "used"])

    near = map_batches(words.where("clean > 0 and clean >= toxic").select("word", "clean"), run, "word string, clean long, entry int, used int")
    near = materialize(near, "toxic-near")
    crowd: Counter = Counter()
    for r in near.groupBy("entry", "used").count().collect():  # an entry has at most two rows
        for edits in range(r["used"], 3):
            crowd[r["entry"], edits] += r["count"]
    safe = [e._replace(edits=max(k for k in range(e.edits + 1) if not k or crowd[i, k] <= MAX_NEAR)) for i, e in enumerate(own)]
    allowed = F.array(*(F.lit(e.edits) for e in safe)) if safe else F.array().cast("array<int>")
    left = near.where(F.col("used") <= F.get(allowed, F.col("entry"))).groupBy("word").agg(F.max("clean").alias("clean"))
    lookalikes = frozenset(r["word"] for r in left.orderBy(F.desc("clean"), "word").limit(MAX_LOOKALIKES).collect())
    release(near)
    return tuple(safe), lookalikes


def fit(features: np.ndarray, labels: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic weights (bias first) by Newton steps, pulled to PRIOR."""
    prior = np.array(PRIOR)
    x = np.hstack([np.ones((len(features), 1)), features])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def _measured(docs: DataFrame, names: list[str], entries: tuple[Entry, ...], excluded: frozenset[str]) -> DataFrame:
    """``names`` of docs, whose text is first, without it; with a column per feature and the terms."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(entries, excluded).hits
        for batch in batches:
            got = [find(text.as_py() or "") for text in batch.column(0)]
            counts = [pa.array([c[k] for c, _ in got], pa.int64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts, pa.array([t for _, t in got], pa.list_(pa.string()))], names=[*names, *FEATURES, "terms"])

    return map_batches(docs, run, f"{schema}, {', '.join(f'{f} long' for f in FEATURES)}, terms array<string>")


class Model:
    """A trained scorer: the lexicon, the lookalikes and the weights."""

    def __init__(self, entries: tuple[Entry, ...], excluded: frozenset[str], weights: Sequence[float]):
        self.entries, self.excluded, self.weights = entries, excluded, [float(w) for w in weights]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: id, score, counts of FEATURES, and the terms found."""
        rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
        out = _measured(rows, ["_id"], self.entries, self.excluded)
        total = F.lit(self.weights[0])
        for name, weight in zip(FEATURES, self.weights[1:], strict=True):
            total = total + weight * F.log1p(F.col(name))
        return out.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-total))).alias("score"), *(F.col(f).alias(f"n_{f}") for f in FEATURES), "terms")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    entries, excluded = choose_lexicon(sample)
    got = _measured(sample.select("text", "label"), ["label"], entries, excluded).select("label", *FEATURES).collect()
    if len({r["label"] for r in got}) < 2:
        return Model(entries, excluded, PRIOR)
    features = np.log1p(np.array([[r[f] for f in FEATURES] for r in got], float))
    return Model(entries, excluded, fit(features, np.array([float(r["label"] == 1) for r in got])))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, counts of hits and the terms.

    Labels of documents in fold 0 are never read, and of other columns than the text none
    enters a score. Null and empty texts score as texts without hits. Rows with equal ids are
    scored one by one. Where no labels of both kinds can be used, the general terms and the
    prior weights score. An empty table gives none.
    """
    out = train(docs, labels, id_col, text_col, label_col).score(docs, id_col, text_col)
    counts = [f"n_{f}" for f in FEATURES]
    return out.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *counts, "terms")
