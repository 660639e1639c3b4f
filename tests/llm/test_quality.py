import math
from collections import defaultdict

from histlab.llm.quality import MAX_STRENGTH, SITE_WEIGHT, THRESHOLD, features, quality, train
from histlab.llm.toxicity import fold

from ..conftest import DATA


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def test_features_are_bounded():
    for text in ("", " ", "a", "!" * 10_000, "# | ! A1, " * 50, "x\n" * 100):
        assert len(features(text)) == 11 and all(0 <= v <= 2 for v in features(text))


def test_posteriors(spark):
    """Grouped aggregation against loops over the rows."""
    docs = spark.read.parquet(DATA + "/documents.parquet")
    labels = spark.read.parquet(DATA + "/labels.parquet")
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    rows = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, r in rows.items():
        hosts[site[i][0]].append(r["evidence"])
        paths[site[i]].append(r["evidence"])
    overall = sum(r["evidence"] for r in rows.values()) / len(rows)

    def strength(groups, above):
        own = [(v, above(k)) for k, v in groups.items() if len(v) >= 2]
        within = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v, _ in own) / sum(len(v) - 1 for v, _ in own)
        between = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in own)
        spread = (between - len(own) * within) / sum(len(v) for v, _ in own)
        return MAX_STRENGTH if spread <= 0 else min(MAX_STRENGTH, max(2.0, within / spread))

    a = strength(hosts, lambda k: overall)
    b = strength(paths, lambda k: (sum(hosts[k[0]]) + a * overall) / (len(hosts[k[0]]) + a))
    for i, r in rows.items():
        p, h, q = r["evidence"], hosts[site[i][0]], paths[site[i]]
        host_mean = (sum(h) - p + a * overall) / (len(h) - 1 + a)
        path_mean = (sum(q) - p + b * host_mean) / (len(q) - 1 + b)
        odds = logit(p) + SITE_WEIGHT * (logit(path_mean) - logit(overall))
        assert abs(r["host_mean"] - host_mean) < 1e-9 and abs(r["path_mean"] - path_mean) < 1e-9
        assert abs(r["probability"] - 1 / (1 + math.exp(-odds))) < 1e-9 and r["accepted"] == (r["probability"] >= THRESHOLD)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(DATA.replace("0.001", "0.1") + "/labels.parquet")
    rows = quality(docs, labels, held_out=fold("doc_id") == 0).join(labels, "doc_id").where(fold("doc_id") == 0).collect()
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["accepted"] for r in good) / len(good) > 0.99
    assert sum(r["accepted"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97


def test_odd(spark, odd, none, labels):
    rows = quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["probability"] <= 1 for r in rows)
    one = labels.where("quality = 1")
    assert train(odd, one) is None and all(r["accepted"] and r["evidence"] == 0.5 for r in quality(odd, one).collect())
    assert quality(none, labels).count() == 0
