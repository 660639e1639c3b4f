import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import histlab.llm.shingle_join as sj
from histlab.llm.components import components


def sets_of(rows, width):
    out = []
    for _, text in rows:
        w = text.encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    return out


def brute(rows, width, percent):
    sets, root, links = sets_of(rows, width), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def got(df, width, percent):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in sj.jaccard_join(df, width=width, percent=percent, links=True).collect()), key=str)


def corpus(seed, n=18):
    rng, rows = random.Random(seed), []
    shared = [f"b{k}" for k in range(12)]
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 20, 60, 120]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[k] = f"x{rng.randrange(500)}"
                else:
                    words.insert(k, f"Y{rng.randrange(50)}")
            rows.append((len(rows), " ".join(shared * (rng.random() < 0.4) + words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, width, percent, block", [(1, 3, 90, None), (2, 5, 80, 1 << 14), (3, 2, 60, 1 << 13), (4, 3, 90, 4096)])
def test_random(spark, monkeypatch, seed, width, percent, block):
    monkeypatch.setattr(sj, "FREQUENT", 4)  # so that small tables have frequent shingles
    if block:  # and large buckets
        monkeypatch.setattr(sj, "BLOCK_BYTES", block)
        monkeypatch.setattr(sj, "CELLS", 300)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, width, percent) == brute(rows, width, percent)


def test_crowded_groups(spark, monkeypatch):
    """Texts with equal prefixes and other bodies, one shingle in all of them, and filters of few bits."""
    monkeypatch.setattr(sj, "FREQUENT", 4)
    monkeypatch.setattr(sj, "FILTER_BITS", 3)
    seen = []
    rest = sj._rest
    monkeypatch.setattr(sj, "_rest", lambda *a: (lambda out: (seen.append(out[1].count()), out)[1])(rest(*a)))
    rng, rows = random.Random(31), []
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(5)]
    for k in range(12):
        head = [f"h{k}x{i}" for i in range(60)]
        for _ in range(4):
            body = [w for p in rng.sample(passages, 2) for w in p]
            for _ in range(rng.choice([0, 0, 1, 2])):
                body[rng.randrange(len(body))] = rng.choice(passages[0])
            rows.append((len(rows), " ".join(["in all of them", *head, *body])))
    rows += [(len(rows) + k, rows[k][1]) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, 3, 90) == brute(rows, 3, 90)
    assert seen[0] > 0


def test_overlaps():
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(30)]
    for left, right in ((sets[:11], sets[11:]), (sets, None)):
        found = sj.overlaps(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(left if right is None else right):
                assert found[i, j] == len(np.intersect1d(a, b)) or (right is None and i == j)


def test_odd(odd, none):
    from .conftest import texts_of

    assert got(odd, 3, 90) == brute(texts_of(odd), 3, 90)
    assert sj.jaccard_join(none).count() == 0


def test_sets():
    texts = ["", " a ", "A b", "a b c d a b c d", "\x0ba\tb\x1cc d e f"]
    for text, found in zip(texts, sj.shingle_sets(pa.array(texts), 3), strict=True):
        assert len(found) == len(sets_of([(0, text)], 3)[0]) and sorted(found.tolist()) == found.tolist()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
