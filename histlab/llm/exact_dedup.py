"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition contributes to one run of digests, which is sorted and reduced to one
row per digest that retains the smallest identifier and the number of rows; so a hot text
shrinks to one row per run before anything else. Runs are then exchanged by the leading
bytes of the digest: each task gets its range of every run, in order. Rounds merge FAN_IN
neighbouring runs at a time, as a binomial tree with merged levels, until a single run is
left. The number of a run is written in digits of base FAN_IN that come last in the order,
so equal digests of runs to be merged stand next to each other and every level streams over
what the level before put out: no level sorts or exchanges again. Each level compares
SHA-256 and the length of the normalised text, so rows merge only where both agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, text_of

RUNS = 64
FAN_IN = 4
#: Leading bytes of the digest that say where a row goes.
LEAD_BYTES = 2


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """One row per input row: run, row number, id, SHA-256 and length of the normalised text."""
    normal = F.regexp_replace(text_of(text_col), f"{SPACE_CLASS}+", " ")
    return docs.select(
        (F.spark_partition_id() % runs).alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        normal.alias("normal"),
    ).select("run", "row", "id", F.unhex(F.sha2("normal", 256)).alias("sha"), F.length("normal").alias("size"))


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs of (run, row, id, sha, size) in rounds; returns sha, size, first, copies."""
    head = F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("first")
    digits = []
    while fan_in ** len(digits) < runs:
        k = len(digits)
        digits.insert(0, F.expr(f"run div {fan_in**k} % {fan_in}").cast("int").alias(f"digit{k}"))
    key = ["lead", "sha", "size", *(f"digit{k}" for k in reversed(range(len(digits))))]
    level = rows.select(F.substring("sha", 1, LEAD_BYTES).alias("lead"), "sha", "size", *digits, head, F.lit(1).cast("long").alias("copies"))

    def merged(level: DataFrame) -> DataFrame:
        return level.groupBy(*key).agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))

    level = merged(level).repartition("lead")
    for _ in digits:
        key.pop()
        level = merged(level)
    return level.select("sha", "size", "first", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of ASCII white space becomes
    one space. Null text counts as empty. The row with the smallest id stays; among rows
    with the same id one is chosen, and rows without an id come last. Columns other than
    the two named are not read, so their names cannot clash. An empty table gives none.
    """
    rows = materialize(digests(docs, id_col, text_col, runs), "digests")
    groups = materialize(merge_runs(rows, runs, fan_in), "digest-groups")
    return rows.join(groups, ["sha", "size"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
