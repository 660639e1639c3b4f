import random
import time

import pytest

from histlab.llm.line_dedup import line_dedup

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    gone = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if (k := x.strip(SPACE).translate(LOWER)) not in gone or gone[k] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["kept_text"], r["_n_lines"], r["_n_dropped"]) for r in df.collect()), key=str)


def test_random(spark):
    rng = random.Random(9)
    lines = [f"{'É' * (i % 4)}Line number {i} of the corpus" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([rng.choice(lines), rng.choice(lines).upper(), "  " + rng.choice(lines) + "\t", "short", "", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(line_dedup(df, min_chars=20, min_docs=5, prefix="_")) == brute(rows, 20, 5)
    assert got(line_dedup(df, min_chars=24, min_docs=30, prefix="_")) == brute(rows, 24, 30)


def test_odd(odd, none):
    from .conftest import texts_of

    out = line_dedup(odd, min_chars=3, min_docs=2, prefix="_")
    assert got(out) == brute(texts_of(odd), 3, 2) and out.columns[: len(odd.columns)] == odd.columns
    assert line_dedup(none, prefix="_").count() == 0
    with pytest.raises(ValueError):
        line_dedup(odd)


def test_many_lines_of_one_text(spark):
    shared = "a line that many documents of this table share"
    own = [f"line {i} of a very long text, which nothing else has at all" for i in range(60_000)]
    rows = [(0, "\n".join([shared, *own, shared]))] + [(i, f"{shared}\nown {i}") for i in range(1, 6)]
    began = time.monotonic()
    out = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert out[0]["kept_text"] == "\n".join(own) and (out[0]["n_lines"], out[0]["n_dropped"]) == (60_002, 2)
    assert out[5]["n_dropped"] == 0 and out[4]["kept_text"] == "own 4"
