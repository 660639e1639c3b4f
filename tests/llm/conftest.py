import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, kept string, run int, ids string, base string, host string, _text string, score double"


def padded(doc_id, text):
    """A row with columns whose names operators use themselves, some of them null."""
    return (doc_id, text, "en" if doc_id else None, None if doc_id == 2 else "src0", None, 7, "x", 1, "x", "x", "x", "x", 0.5)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta,", "gämma", "Δelta", "x1"]) + ("\n" if rng.random() < 0.05 else "") for _ in range(60_000))
    rows = [
        (1, "One two three four five six seven eight nine ten eleven."), (2, None), (3, ""), (None, None), (None, "a nameless text of a few words"), (4, " \n\t "),
        (5, long), (6, "x" * 50_000), (7, "same text here"), (7, "same text here"), (8, "same  text\nhere"), (7, "other text"), (9, "\n\n"), (10, "日本語" * 400),
    ]
    return spark.createDataFrame([padded(*r) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def texts_of(df):
    """Rows of a table as (id, text), nulls as empty."""
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]
