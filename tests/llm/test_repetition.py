import collections
import random

import histlab.llm.repetition as rp
from histlab.llm.repetition import measure, quality_rules


def windows(words, k=5):
    places = collections.defaultdict(list)
    for i in range(len(words) - k + 1):
        places[tuple(words[i : i + k])].append(i)
    return len({i + d for v in places.values() if len(v) > 1 for i in v for d in range(k)})


def longest(t, least):
    n, covered, best = len(t), set(), 0
    for i in range(n):
        most = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and t[i + k] == t[j + k]:
                k += 1
            most = max(most, k)
        size = sum(map(len, t[i : i + most]))
        best = max(best, size)
        if most and size >= least:
            covered.update(range(i, i + most))
    return sum(len(t[i]) for i in covered), best


def test_measures(monkeypatch):
    rng = random.Random(3)
    for large in (1 << 20, 1):
        monkeypatch.setattr(rp, "LARGE_TOKENS", large)
        for _ in range(80):
            texts = []
            for _ in range(rng.randint(1, 5)):
                few = rng.randint(1, 5)
                texts.append([rng.choice([b"ab", b"cde", b"f", b"x" * rng.choice([3, 70])]) if rng.random() < 0.5 else bytes([97 + rng.randrange(few)]) for _ in range(rng.randint(0, 35))])
            repeated, covered, most = measure(texts, 6)
            for i, words in enumerate(texts):
                assert repeated[i] == windows(words) and (covered[i], most[i]) == longest(rp._fine(words), 6)


def test_odd(odd, none):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules(odd).collect()}
    for (doc_id, n), r in rows.items():
        if doc_id == 1:
            assert r["kept"] and n == 11 and r["n_repeat_words"] == 0
        if doc_id in (2, 3, 4, 9):
            assert n == 0 and r["base_failed"] and not r["kept"] and r["covered_share"] == 0
        if doc_id == 6:
            assert n == 1 and r["covered_bytes"] == 50_000
        if doc_id == 10:
            assert r["word_chars"] == 1200 and r["longest_repeat_bytes"] == 3591
    assert quality_rules(none).count() == 0


def test_base(spark):
    text = "# a b c d e\nq\n a b c d e\nq\n\n*%\x85 x\n"
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.encode().split()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), 3, 1, 12)


def test_repeats_without_spaces_go(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:10] * 20)), (3, " ".join(words) + " " + "abcdefghij" * 300)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: True, 2: False, 3: False}


def test_repeats_do_not_depend_on_word_length(spark):
    urls = " ".join(f"https://shop.example.com/catalog/electronics/item-{i:05d}" for i in range(200))
    phrases = " ".join("日本語の文章がここにあります" + chr(0x4E00 + i) for i in range(200))
    plain = " ".join(f"{i * 7919 % 100_003}" for i in range(2000))
    rows = [(1, urls), (2, phrases), (3, plain)]
    out = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["kept"] for i, r in out.items()} == {1: False, 2: False, 3: True}
    assert out[1]["n_repeat_words"] == 0 and out[1]["covered_share"] > 0.99 and out[1]["longest_repeat_bytes"] >= 50


def test_characters_against_brute_force(monkeypatch):
    rng = random.Random(4)
    for large in (1 << 20, 1):
        monkeypatch.setattr(rp, "LARGE_TOKENS", large)
        for _ in range(60):
            texts = [["".join(rng.choice("abé日本") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 4))]
            _, covered, most = measure(texts, 6)
            for i, words in enumerate(texts):
                assert (covered[i], most[i]) == longest(rp._fine(words), 6)
