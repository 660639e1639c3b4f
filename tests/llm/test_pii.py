import itertools
import math
import random
import re
import time

import numpy as np

from histlab.llm import pii


def naive(text):
    digits = pii._digits
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_is_exact():
    rng = random.Random(6)
    bits = ["a", "@", "b.c", ".", "-", "1", "23", "255", " ", "+4", "(0)", "4111111111111111", "4111 1111 1111 1111", "x@y.z", "_", "\n", "é", "٣"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == naive(text), text


def test_long_texts_take_linear_time():
    """Twice the text takes about twice the time, whatever it repeats."""
    model = pii.weights()

    def seconds(work, text):
        began = time.process_time()
        work(text)
        return time.process_time() - began

    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 50_000):
        assert seconds(pii.base_spans, text * 2) < 5 * seconds(pii.base_spans, text) + 0.5, text[:9]
    for text in ("a@b.c " * 10_000, "123 4567 " * 2000, "a at b dot c " * 2000, "+49 123 456 7890, " * 2000, "x" * 100_000):
        assert seconds(lambda t: pii.find(t, model), text * 2) < 5 * seconds(lambda t: pii.find(t, model), text) + 1, text[:9]
    base, added = pii.find("a@b.c " * 100_000, model)
    assert len(base["email"]) == 100_000 and not added


def test_very_long_numbers():
    assert pii.base_spans("1.2.3." + "0" * 5000) == {"email": [], "ip": [(0, 5006)], "card": [], "phone": []}
    assert not any(pii.base_spans("1.2.3." + "9" * 5000).values())
    assert pii.base_spans("0" * 5000 + "1.2.3.255")["ip"] == [(0, 5009)] and not pii.base_spans("1.2.3.256")["ip"]


def test_model_on_new_sentences():
    rng, weights = random.Random(77), pii.weights()
    hit = wrong = missed = 0
    for _ in range(400):
        text, gold = pii._sentence(rng)
        tokens = pii.tokens_of(text)
        found = {(tokens[i][0], tokens[j - 1][1], k) for i, j, k in pii.segment(text, tokens, weights)}
        hit, wrong, missed = hit + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.93


def segmentations(text, tokens, i=0):
    """All of them, as lists of (first token, end token, label number)."""
    if i == len(tokens):
        yield []
        return
    for rest in segmentations(text, tokens, i + 1):
        yield [(i, i + 1, 0), *rest]
    for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1):
        if pii.candidate(text, tokens, i, j):
            for rest in segmentations(text, tokens, j):
                for y in range(1, len(pii.LABELS)):
                    yield [(i, j, y), *rest]


def score(text, tokens, model, segments):
    labels = [0, *(y for _, _, y in segments)]
    total = sum(model.moves[x][y] for x, y in itertools.pairwise(labels))
    return total + sum(model.scores(pii.span_features(text, tokens, i, j))[y - 1] for i, j, y in segments if y)


SHORT = ("bob@x.org or 555-1234 12", "call 5551234 5557654", "a at b dot c 12 34567", "no sign here", "@ 1234567 @", "1234 5678\n99")


def test_dynamic_program_is_the_best_segmentation():
    model = pii.weights()
    for text in SHORT:
        tokens = pii.tokens_of(text)
        found, place, made = pii.segment(text, tokens, model), 0, []
        for i, j, kind in found:
            made += [(k, k + 1, 0) for k in range(place, i)] + [(i, j, pii.LABELS.index(kind))]
            place = j
        made += [(k, k + 1, 0) for k in range(place, len(tokens))]
        assert abs(score(text, tokens, model, made) - max(score(text, tokens, model, s) for s in segmentations(text, tokens))) < 1e-9


def lattice(rng, texts):
    """A lattice over the texts with random gold segments, and random weights."""
    data = []
    for text in texts:
        tokens, place, gold = pii.tokens_of(text), 0, []
        for i, j in pii.candidates(text, tokens):
            if i >= place and rng.random() < 0.2:
                gold.append((i, j, rng.choice(pii.TYPES)))
                place = j
        data.append((text, tokens, gold))
    names = {}
    made = pii.Lattice(data, names)
    own = np.random.default_rng(1)
    return data, made, names, own.normal(size=(len(names), len(pii.TYPES))), own.normal(size=(len(pii.LABELS),) * 2)


def test_partition_function_counts_every_segmentation():
    for text in SHORT:
        data, made, names, weights, moves = lattice(random.Random(3), [text])
        model = pii.Model({f: weights[k].tolist() for f, k in names.items()}, moves.tolist())
        (_, tokens, gold), place, own = data[0], 0, []
        for i, j, kind in gold:
            own += [(k, k + 1, 0) for k in range(place, i)] + [(i, j, pii.LABELS.index(kind))]
            place = j
        own += [(k, k + 1, 0) for k in range(place, len(tokens))]
        whole = math.log(sum(math.exp(score(text, tokens, model, s)) for s in segmentations(text, tokens)))
        assert abs(made.likelihood(made.matrix(len(names)), weights, moves)[0] - (score(text, tokens, model, own) - whole)) < 1e-8


def test_gradient_is_that_of_the_likelihood():
    rng = random.Random(5)
    _, made, names, weights, moves = lattice(rng, [*SHORT, *(pii._sentence(rng)[0] for _ in range(6))])
    x = made.matrix(len(names))
    _, slope, slope_moves = made.likelihood(x, weights, moves)
    for values, slopes in ((weights, slope), (moves, slope_moves)):
        for _ in range(25):
            k = rng.randrange(values.shape[0]), rng.randrange(values.shape[1])
            kept, step = values[k], 1e-5
            values[k] = kept + step
            up = made.likelihood(x, weights, moves)[0]
            values[k] = kept - step
            down = made.likelihood(x, weights, moves)[0]
            values[k] = kept
            assert abs((up - down) / (2 * step) - slopes[k]) < 1e-4


def test_candidates_are_those_of_the_definition():
    rng = random.Random(12)
    bits = ["bob", " ", "1", "23", "4567", "_", "@", " at ", "[at]", " (AT) ", ".", " dot ", "[dot]", "\n", "-", ", ", "٣", "9" * 20]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        tokens = pii.tokens_of(text)
        want = [(i, j) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1) if pii.candidate(text, tokens, i, j)]
        assert list(pii.candidates(text, tokens)) == want, text


def test_odd(odd, none):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and {r["doc_id"]: r["text"] for r in out.collect()}[2] is None


def test_redaction(spark):
    text = "Write jo.24@mail6.example.com, call +1 (366) 555-9807 or 42.144.35.254; card 4041894974608795. Version 1.2.3 of 2024-01-02."
    (r,) = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["text"].startswith("Write <email>, call <phone> or <ip>") and r["text"].endswith("Version 1.2.3 of 2024-01-02.") and "5555" not in r["text"]
    weights = pii.weights()
    _, added = pii.find("Please mail anna [at] host [dot] org today, my ssn 123-45-6789.", weights)
    assert {k for _, _, k in added} == {"email", "ssn"}


def test_gate_lets_every_candidate_through():
    rng, weights = random.Random(79), pii.weights()
    hit = wrong = missed = 0
    for _ in range(400):
        text, gold = pii._sentence(rng)
        base, added = pii.find(text, weights)
        found = {(a, b, k) for k in pii.BASE for a, b in base[k]} | set(added)
        hit, wrong, missed = hit + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93
    bits = ["bob", " ", "1", "23", "4567", "_", "@", " at ", "[at]", " (at) ", ".", " dot ", "[dot]", "\n", "x" * 70, "-", ", "]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        tokens, inside = pii.tokens_of(text), pii.regions(text)
        shortest = [(i, j) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1) if pii.candidate(text, tokens, i, j)]
        for i, j in shortest:
            assert any(a < tokens[j - 1][1] and tokens[i][0] < b for a, b in inside), text
            if pii._SHAPES["spelled"].fullmatch(text[tokens[i][0] : tokens[j - 1][1]]):
                assert any(a <= tokens[i][0] and tokens[j - 1][1] <= b for a, b in inside), text


def test_spelled_addresses_are_found():
    weights = pii.weights()
    long = f"{'verylong' * 7} (dot) example (dot) org"
    for made in ("john (at) example.com", "john [at] mail.example.org", f"john (at) {long}", "anna at host dot org"):
        text = f"Dear all, please write {made} today"
        _, added = pii.find(text, weights)
        assert [(text[a:b], k) for a, b, k in added] == [(made, "email")]
    for plain in ("Have a look at example.com for more", "We were at home.He said nothing", "from 1999 and 2003 on", "He sold 120 pens and 45000 caps"):
        assert not pii.find(plain, weights)[1], plain
