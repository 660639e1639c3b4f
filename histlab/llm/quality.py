"""Quality classifier with hierarchical empirical Bayes.

A logistic model judges each document by its text. Its probabilities are summed per path
and per host by grouped aggregation. A host's posterior mean shrinks its sum towards the
global mean, a path's shrinks towards its host's; how strongly, the spread between sites
says (method of moments), so sparse sites stay near what is above them. The evidence of a
document's own site, without the document itself, moves its log-odds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, materialize, release, resting_on

#: Bound of the labelled sample: documents of either label, by the smallest hash of the id.
MAX_EACH = 4000
#: Weight of the site's evidence on the log-odds of a document.
SITE_WEIGHT = 0.5
#: Documents below this probability are rejected.
THRESHOLD = 0.25
#: Bounds of the prior strength that is estimated, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0

FEATURES = ("words", "word_length", "symbols", "capitals", "shouts", "digits", "bars", "ends", "distinct", "runs", "lines")


def features(text: str) -> list[float]:
    """Measures of a text; all are bounded, and 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    symbols = sum(map(text.count, "#*$%&<>@^~="))
    digits = sum(any(c.isdigit() for c in w) for w in words) if any(map(text.__contains__, "0123456789")) else 0
    ends = sum(w[-1] in ".,;:" for w in words)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    counts = Counter(words)
    return [
        min(math.log1p(n) / 8, 1.5),
        min(chars / n / 10, 2.0),
        min(symbols / n, 2.0),
        capitals / n,
        min(text.count("!") / n, 2.0),
        digits / n,
        min(text.count("|") / n, 1.0),
        ends / n,
        len(counts) / n,
        runs / n,
        min((text.count("\n") + 1) / n, 1.0),
    ]


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.05) -> np.ndarray:
    """Logistic weights, bias first, by Newton steps with both labels weighing the same."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + pull * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None) -> list[float] | None:
    """Weights from at most MAX_EACH documents of either label; None where a label is missing.

    ``held_out`` is a condition on the labels whose documents are not learned from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    part = lambda v: known.where(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(MAX_EACH)
    ids = materialize(part(0).unionByName(part(1)), "quality-ids")
    # At most 2 * MAX_EACH ids, so the broadcast is bounded.
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("_id")).join(F.broadcast(ids), "_id").select("text", "label")
    schema = f"{', '.join(f'{f} double' for f in FEATURES)}, label int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([features(t.as_py() or "") for t in batch.column(0)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(got[:, k]) for k in range(len(FEATURES))), batch.column(1).cast(pa.int32())], names=[*FEATURES, "label"])

    got = np.array([list(r) for r in map_batches(rows, run, schema).collect()], float).reshape(-1, len(FEATURES) + 1)
    if len(set(got[:, -1])) < 2:
        return None
    return fit(got[:, :-1], got[:, -1]).tolist()


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, weights: Sequence[float] | None, text_col: str = "text") -> DataFrame:
    """(every column, evidence): the probability by the text alone; 0.5 without weights.

    Null text counts as empty. Other columns are carried as they are.
    """
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    w = np.array(weights if weights is not None else [0.0] * (len(FEATURES) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "evidence"])

    return map_batches(docs, run, f"{schema}, evidence double")


def strength(groups: DataFrame, above: str) -> float:
    """Prior strength in documents, from groups (n, sum, squares): the within-group variance over the spread of group means."""
    m = F.col("sum") / F.col("n")
    row = groups.where("n >= 2").agg(
        F.sum(F.col("squares") - F.col("sum") * m).alias("within"),
        F.sum(F.col("n") - 1).alias("freedom"),
        F.sum(F.col("n") * (m - F.col(above)) ** 2).alias("between"),
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
    ).first()
    if not row["groups"] or not row["freedom"]:
        return MAX_STRENGTH
    within = row["within"] / row["freedom"]
    spread = (row["between"] - row["groups"] * within) / row["n"]
    return MAX_STRENGTH if spread <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, within / spread))


def site_posteriors(judged: DataFrame) -> DataFrame:
    """From stored (host, path, evidence), stored: host, path, n, sum and the posterior means above a document."""
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("sum"), F.sum(F.col("evidence") ** 2).alias("squares")]
    paths = materialize(judged.groupBy("host", "path").agg(*sums), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).first()
    overall = total["sum"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    hosts = hosts_table = materialize(hosts.withColumn("overall", F.lit(overall)), "quality-hosts")
    a = strength(hosts, "overall")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("sum").alias("host_sum"), ((F.col("sum") + a * overall) / (F.col("n") + a)).alias("host_mean"))
    joined = materialize(paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host), "quality-sites")
    b = strength(joined, "host_mean")
    out = joined.drop("squares").withColumns({"overall": F.lit(overall), "host_strength": F.lit(a), "path_strength": F.lit(b)})
    out = materialize(out, "quality-posteriors")
    release(paths, hosts_table, joined)
    return out


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    label_col: str = "quality",
    held_out: Column | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, evidence, host_mean, path_mean, probability, accepted.

    ``host`` and ``path`` are columns of docs; source, and source with language, where they
    are not given. Null hosts and paths are sites of their own. A document's means leave the
    document itself out, so the only document of a site has the mean above it. Null and empty
    texts are judged as texts without words. Rows with equal ids are judged one by one. Without
    labels of both kinds all evidence is 0.5 and all documents are accepted. Columns other
    than those named are not read. An empty table gives none.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    weights = train(docs, labels, id_col, text_col, label_col, held_out)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    judged = materialize(classify(rows, weights).drop("text"), "quality-judged")
    # Sites as many as there are: broadcast only where the table has been measured and is small.
    stored = site_posteriors(judged)
    sites = broadcast_if_small(stored).withColumnsRenamed({"host": "s_host", "path": "s_path"})
    out = judged.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    own = F.col("evidence")
    a, b, overall = F.col("host_strength"), F.col("path_strength"), F.col("overall")
    host_mean = (F.col("host_sum") - own + a * overall) / (F.col("host_n") - 1 + a)
    path_mean = (F.col("sum") - own + b * host_mean) / (F.col("n") - 1 + b)
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    odds = _logit(own) + SITE_WEIGHT * (_logit(F.col("path_mean")) - _logit(overall))
    out = out.withColumn("probability", 1 / (1 + F.exp(-odds)))
    out = out.select(F.col("id").alias(id_col), "evidence", "host_mean", "path_mean", "probability", (F.col("probability") >= threshold).alias("accepted"))
    return resting_on(out, judged, stored)
