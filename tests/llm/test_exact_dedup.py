import hashlib
import re

from histlab.llm.exact_dedup import digests, exact_dedup, merge_runs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    return groups


def check(df, rows):
    groups, seen = brute(rows), {}
    for r in df.collect():
        seen.setdefault(r["text_sha256"], []).append(r)
    assert len(seen) == len(groups)
    for text, ids in groups.items():
        own = seen[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in own)
        assert all(r["keep_id"] == keep and r["group_size"] == len(ids) for r in own)
        assert [r["doc_id"] for r in own if r["kept"]] == [keep]


def test_odd(spark, odd, none):
    from .conftest import texts_of

    check(exact_dedup(odd), texts_of(odd))
    assert exact_dedup(none).count() == 0


def test_many_runs(spark):
    rows = [(i, f"text {i % 37}" + " " * (i % 3 + 1) + "end") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    check(exact_dedup(df), rows)
    check(exact_dedup(df, runs=8, fan_in=2), rows)
    check(exact_dedup(df, runs=5, fan_in=3), rows)
    check(exact_dedup(df, runs=1), rows)


def test_levels_neither_sort_nor_exchange(spark):
    """However many rounds: sorted runs are made, exchanged once and brought in order once."""
    rows = digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plans = [merge_runs(rows, runs, fan_in)._jdf.queryExecution().executedPlan().toString() for runs, fan_in in ((64, 4), (64, 2), (1024, 2))]
    for plan in plans:
        assert plan.count("Sort [") == 3 and plan.count("Exchange hashpartitioning") == 2 and "Arrow" not in plan
    assert plans[2].count("SortAggregate") > plans[1].count("SortAggregate") > plans[0].count("SortAggregate")
