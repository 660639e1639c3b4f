"""Streaming sessions: by gap, and by the tab-event state machine."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import GAP_SECONDS
from ..operators.tabs import COLUMNS, SESSION_SCHEMA, new_user, process, summary


def stream_sessions(events: DataFrame, delay: str | None = None, key: str = "user_id", ts: str = "ts", gap: int = GAP_SECONDS) -> DataFrame:
    """start, end and pages of sessions. With ``delay`` only closed ones are given (append); without, all (complete)."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay:
        events = events.withWatermark(ts, delay)
    window = F.session_window(F.col(ts), f"{gap} seconds")
    return events.groupBy(key, window.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("page_count")).drop("w")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    user = json.loads(state.get[0]) if state.exists else new_user()
    # A batch may give a user's events in any order; within it they are sorted, as in the batch form.
    parts = list(batches)
    rows = pd.concat(parts).sort_values(["us", "event_id"]) if parts else pd.DataFrame()
    out = []
    for row in rows.itertuples(index=False):
        closed = process(user, row.type, int(row.tab_id), row.url or "", row.title or "", int(row.us))
        if closed:
            out.append(summary(key[0], closed))
    if user["current"]:
        out.append(summary(key[0], user["current"]))
    state.update((json.dumps(user),))
    if out:
        yield pd.DataFrame(out, columns=COLUMNS)


def stream_tab_sessions(events: DataFrame) -> DataFrame:
    """Sessions of the state machine as they stand after each batch (update mode): of rows with the
    same user and session, the last one counts. Late events belong to the current session."""
    rows = events.select("user_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"), "event_id", "type", "tab_id", "url", "title")
    return rows.groupBy("user_id").applyInPandasWithState(_advance, SESSION_SCHEMA, "state string", "update", GroupStateTimeout.NoTimeout)
