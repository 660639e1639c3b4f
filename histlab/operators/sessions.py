"""Sessions by time gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import PLACE, RANGE, carried, in_ranges

GAP_SECONDS = 1800


def with_session(visits: DataFrame, key: str | None = "user_id", ts: str = "ts", tie: str = "event_id", gap: int = GAP_SECONDS) -> DataFrame:
    """``visits`` with session_no from 1 per key; a new one begins after more than ``gap`` seconds.

    Without a key all rows are one sequence: it is cut into ranges of time, and the last time
    and the number of sessions are carried from range to range.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))

    def starts(of) -> DataFrame:
        before = F.lag(ts).over(of)
        if not key:
            before = F.coalesce(before, F.col("_last"))
        apart = micros(F.col(ts)) - micros(before)
        return rows.withColumn("_starts", F.when(apart.isNull() | (apart > gap * 1_000_000), 1).otherwise(0))

    if key:
        rows, of = visits, Window.partitionBy(key).orderBy(ts, tie)
        return starts(of).withColumn("session_no", F.sum("_starts").over(of)).drop("_starts")
    rows = carried(in_ranges(visits, [F.asc(ts), F.asc(tie)]), F.max(ts), F.max, "_last")
    of = Window.partitionBy(RANGE).orderBy(PLACE)
    out = carried(starts(of), F.sum("_starts"), F.sum, "_sessions")
    number = F.coalesce("_sessions", F.lit(0)) + F.sum("_starts").over(of)
    return out.withColumn("session_no", number).drop("_starts", "_sessions", "_last", RANGE, PLACE)


def sessions(visits: DataFrame, key: str | None = "user_id", ts: str = "ts", tie: str = "event_id", gap: int = GAP_SECONDS) -> DataFrame:
    """One row per session: start, end, pages, minutes, tabs (1: visits don't tell tabs), final state."""
    keys = [key] if key else []
    pages = F.count("*")
    seconds = F.expr(f"(unix_micros(cast(max({ts}) as timestamp)) - unix_micros(cast(min({ts}) as timestamp))) div 1000000")
    return with_session(visits, key, ts, tie, gap).groupBy(*keys, "session_no").agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        pages.alias("page_count"),
        (seconds / 60.0).alias("minutes"),
        F.lit(1).alias("tab_count"),
        # One tab and no switches: the fourth page makes a session deep.
        F.when(pages > 3, "DEEP_BROWSE").otherwise("ACTIVE").alias("state"),
    )


def sessions_builtin(visits: DataFrame, key: str = "user_id", ts: str = "ts", gap: int = GAP_SECONDS) -> DataFrame:
    """start, end and pages of sessions by the engine's session window; the same sessions for whole microseconds."""
    window = F.session_window(F.col(ts).cast("timestamp"), f"{gap} seconds")
    return visits.groupBy(key, window.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("page_count")).drop("w")


def session_stats(found: DataFrame, order: list[str]) -> DataFrame:
    """One row: totals, averages, the longest session and the one with most tabs, the first of equals in ``order``."""
    first = [(-F.col(c)).alias(f"_{c}") for c in order]
    longest = F.max_by(F.struct(*order), F.struct("minutes", *first))
    most = F.max_by(F.struct(*order), F.struct("tab_count", *first))
    out = found.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("total_pages"),
        F.avg("minutes").alias("avg_minutes"),
        F.avg("tab_count").alias("avg_tabs"),
        F.max("minutes").alias("longest_minutes"),
        F.when(F.max("minutes") > 0, longest).alias("longest"),
        F.when(F.max("tab_count") > 0, most).alias("most"),
    )
    extra = [F.col(f"longest.{c}").alias(f"longest_{c}") for c in order] + [F.col(f"most.{c}").alias(f"most_tabs_{c}") for c in order]
    return out.select("total_sessions", "total_pages", "avg_minutes", "avg_tabs", "longest_minutes", *extra)
