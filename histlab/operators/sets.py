"""Unions, merges, time filters and retention."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bag_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, by column name, duplicates kept."""
    return reduce(DataFrame.unionByName, tables)


def merge_by_url(history: DataFrame) -> DataFrame:
    """One row per exact URL: title and typed count of its first row, the most visits, the last visit.

    A single hash aggregate by URL; equal rows are combined before the shuffle.
    """
    first = F.struct("pos")
    return history.groupBy("url").agg(
        F.min("pos").alias("pos"),
        F.min_by("title", first).alias("title"),
        F.max("visit_count").alias("visit_count"),
        F.min_by("typed_count", first).alias("typed_count"),
        F.max("last_visit").alias("last_visit"),
    )


def since(history: DataFrame, now: datetime | Column, days: int, inclusive: bool, column: str = "last_visit") -> DataFrame:
    """Rows after the moment ``days`` before ``now``; not at it unless ``inclusive``. No filter for 0 days."""
    if days <= 0:
        return history
    cutoff = F.lit(now) - F.expr(f"interval {days} days")
    return history.where(F.col(column) >= cutoff if inclusive else F.col(column) > cutoff)


def last_n(history: DataFrame, n: int, column: str = "last_visit", tie: str = "pos") -> DataFrame:
    """The n latest rows, the smaller ``tie`` first among equals."""
    return history.orderBy(F.desc(column), tie).limit(n)


def drop_consecutive(events: DataFrame, keys: list[str], order: list[str], value: str = "url") -> DataFrame:
    """Rows whose value differs from the one before, within each key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def keep_latest(events: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first n rows by ``order`` of each key."""
    return events.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def with_metadata(visits: DataFrame, metadata: DataFrame, tolerance: str = "30 seconds") -> DataFrame:
    """Each metadata row goes to the latest visit of its tab at or before it, within ``tolerance``.

    visits: tab_id, ts, event_id and more; metadata: tab_id, ts, description, keywords. Visits
    without metadata keep nulls; of several metadata rows the last one counts.
    """
    v = visits.select("tab_id", F.col("ts"), "event_id").withColumn("kind", F.lit(0))
    m = metadata.select("tab_id", "ts", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("kind"), F.struct("description", "keywords", "ts").alias("meta"))
    both = v.withColumn("meta", F.lit(None).cast(m.schema["meta"].dataType)).unionByName(m)
    of = Window.partitionBy("tab_id").orderBy("ts", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == 0, F.struct("event_id", "ts")), ignorenulls=True).over(of)
    found = both.withColumn("visit", at).where((F.col("kind") == 1) & F.col("visit").isNotNull())
    found = found.where(F.col("ts") <= F.col("visit.ts") + F.expr(f"interval {tolerance}"))
    last = found.groupBy(F.col("visit.event_id").alias("event_id")).agg(F.max_by("meta", F.col("meta.ts")).alias("meta"))
    return visits.join(last, "event_id", "left").withColumns({"description": F.col("meta.description"), "keywords": F.col("meta.keywords")}).drop("meta")
