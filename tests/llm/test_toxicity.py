import random

import pytest

from histlab.llm.toxicity import LexiconAutomaton, Matcher, entry, fit, fold, quotation, toxicity, train

from ..conftest import DATA


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


ENTRIES = [entry("idiot"), entry("moron"), entry("worthless"), entry("vequ", True), entry("scum"), entry("achlich", True), entry("ass"), entry("scumbag")]


def brute(word):
    """All (edits, is stem, entry) by whole tables of distances."""
    out = []
    for k, e in enumerate(ENTRIES):
        edits = min(distance(word[:n], e.text) for n in range(1, len(word) + 1)) if e.stem else distance(word, e.text)
        if edits <= e.edits:
            out.append((edits, e.stem, k))
    return out


def test_automaton_is_levenshtein():
    rng = random.Random(1)
    own = LexiconAutomaton(ENTRIES)
    for _ in range(6000):
        word = list(rng.choice(ENTRIES).text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "o", "x"])
        word = "".join(word) + rng.choice(["", "", "xy"])
        if not word:
            continue
        want, found = brute(word), own.match(word)
        assert found == ((min(want)[2], min(want)[0]) if want else None), (word, found, want)
        assert {(k, used) for used, _, k in want} <= {(k, used) for used, k in own.found(word)}
    for word, text in (("scvm", "scum"), ("diot", "idiot"), ("tidiot", "idiot"), ("ydiot", "idiot"), ("orthles", "worthless"), ("xchlichkeit", "achlich")):
        assert ENTRIES[own.match(word)[0]].text == text
    assert own.match("as") is None and own.match("") is None


def test_hits():
    m = Matcher([entry("idiot"), entry("worthless"), entry("scum"), entry("vequau", True)], frozenset({"idior"}))
    assert m.hits("You IDIOT")[0] == [1, 0, 0, 0, 0, 1]
    assert m.hits("IDIOT, id1ot i.d.i.o.t worthles sc*m idior vequaux bequaux")[0] == [3, 1, 2, 1, 0, 0]
    assert m.hits('He said "what an idiot" again')[0] == [0, 0, 0, 0, 1, 0]
    assert m.hits("nothing here")[0] == [0] * 6 and m.hits("")[1] == []


def test_crowded_entries_allow_no_edits(spark):
    from histlab.llm.toxicity import MAX_NEAR, _safe

    near = [(a + "oron", 0, 5) for a in "abcdefghijklnopqrstuvwxyzäöü"]
    assert len(near) > MAX_NEAR
    words = spark.createDataFrame([*near, ("idiom", 0, 9), ("idiots", 4, 2), ("moron", 9, 0)], "word string, toxic long, clean long")
    entries, lookalikes = _safe(words, [entry("moron"), entry("idiot")])
    assert [e.edits for e in entries] == [0, 1] and lookalikes == {"idiom"}


def test_quotation():
    assert quotation('he wrote "idiot" there'.split(), 2) and quotation("“such an idiot now”".split(), 2)
    assert not quotation("such an idiot".split(), 2) and not quotation('"yes" you idiot "no"'.split(), 2)


def test_fit_follows_the_labels():
    import numpy as np

    x = np.array([[0, 0, 0, 0, 0, 0]] * 50 + [[1, 0, 0, 0, 0, 0]] * 50, float)
    w = fit(x, np.array([0.0] * 50 + [1.0] * 50))
    assert w[0] < 0 < w[0] + w[1]


def test_odd(spark, odd, none, labels):
    rows = toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity(none, labels).count() == 0
    (r,) = toxicity(spark.createDataFrame([(1, "you moron")], "doc_id long, text string"), labels.limit(0)).collect()
    assert r["predicted"] == 1 and r["terms"] == ["moron"]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(DATA.replace("0.001", "0.1") + "/documents.parquet"), spark.read.parquet(DATA.replace("0.001", "0.1") + "/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    held = toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in held)
    assert len(held) > 500 and hit / len(held) > 0.98


def test_misspelled_terms_are_found(spark, tables):
    """Every letter of a term changed in turn; what is then a known clean word is let alone."""
    model = train(*tables)
    words = [e for e in model.entries if not e.stem and e.edits and len(e.text) >= 5]
    assert len(words) > 5
    bent = [(e.text[:k] + "#" + e.text[k + 1 :]) for e in words for k in range(len(e.text)) if e.text[:k] + e.text[k + 1 :] not in model.excluded]
    assert len(bent) > 50
    rows = [(i, f"so {w} it was, {w}") for i, w in enumerate(bent)]
    scored = model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_fuzzy"] + r["n_exact"] + r["n_stem"] + r["n_fuzzy_stem"] > 0 for r in scored) == len(rows)


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", (fold("doc_id") == 0).cast("int") * (1 - labels.toxic) + (fold("doc_id") != 0).cast("int") * labels.toxic)
    one, other = train(docs, flipped), train(docs, labels)
    assert (one.entries, one.excluded, one.weights) == (other.entries, other.excluded, other.weights)
