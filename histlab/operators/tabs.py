"""The tab-event state machine: sessions, tabs, navigation stacks, activity states.

One pure-Python machine serves the batch and the streaming form. State is a plain dict, so
it can be stored between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

GAP_US = 1800 * 1_000_000
RAPID_US, CALM_US = 60_000_000, 30_000_000
MAX_TABS, MAX_CHAIN = 64, 128
STATES = ("IDLE", "ACTIVE", "DEEP_BROWSE", "RAPID_FIRE")
EVENTS = ("OPEN", "CLOSE", "NAVIGATE", "SWITCH", "RELOAD", "BACK", "FORWARD")

SESSION_SCHEMA = (
    "user_id long, session_no long, start_us long, end_us long, page_count long, tab_count long, max_concurrent_tabs long, "
    "tab_switches long, minutes double, state string, transitions map<string,long>"
)


def new_user() -> dict:
    return {"sessions": 0, "last": 0, "current": None}


def _new_session(number: int, at: int) -> dict:
    return {"no": number, "start": at, "end": at, "pages": 0, "tabs": [], "active": -1, "next": 1, "most": 0, "switches": 0, "state": "ACTIVE", "moves": {}}


def _add_tab(s: dict, at: int) -> dict | None:
    if len(s["tabs"]) >= MAX_TABS:
        return None
    tab = {"id": s["next"], "open": True, "opened": at, "last": at, "stack": [], "at": -1, "url": "", "title": "", "referrer": "", "loads": 0}
    s["next"] += 1
    s["tabs"].append(tab)
    s["most"] = max(s["most"], sum(t["open"] for t in s["tabs"]))
    return tab


def _find(s: dict, tab_id: int) -> dict | None:
    return next((t for t in s["tabs"] if t["id"] == tab_id), None)


def _active(s: dict) -> dict | None:
    tab = _find(s, s["active"]) if s["active"] > 0 else None
    return tab if tab and tab["open"] else None


def visit(tab: dict, url: str, title: str) -> None:
    """Go to a page: what lay ahead goes, and the oldest entry where the stack is full."""
    del tab["stack"][tab["at"] + 1 :]
    if len(tab["stack"]) >= MAX_CHAIN:
        del tab["stack"][0]
    tab["stack"].append(url)
    tab["at"] = len(tab["stack"]) - 1
    tab["referrer"], tab["url"], tab["title"] = tab["url"], url, title
    tab["loads"] += 1


def step(tab: dict, by: int) -> bool:
    """Go back (-1) or forward (1) where that is possible."""
    to = tab["at"] + by
    if not 0 <= to < len(tab["stack"]):
        return False
    tab["at"] = to
    tab["referrer"], tab["url"] = tab["url"], tab["stack"][to]
    return True


def next_state(s: dict, at: int, kind: str) -> str:
    """The state after an event. The session's end has been moved already, so at most 0 has passed since."""
    passed, state = at - s["end"], s["state"]
    if passed > GAP_US:
        return "IDLE"
    if state == "IDLE" and kind in ("OPEN", "NAVIGATE"):
        return "ACTIVE"
    if state == "ACTIVE":
        if s["switches"] == 0 and s["pages"] > 3:
            return "DEEP_BROWSE"
        if s["switches"] > 5 and passed < RAPID_US:
            return "RAPID_FIRE"
    if state == "DEEP_BROWSE" and kind == "SWITCH":
        return "ACTIVE"
    if state == "RAPID_FIRE" and passed > CALM_US:
        return "ACTIVE"
    return state


def process(user: dict, kind: str, tab_id: int, url: str, title: str, at: int) -> dict | None:
    """Apply one event; gives the session that it closed, if any.

    A time that is missing (0 or less) is one second after the event before. Late events
    belong to the current session and don't move its end back.
    """
    if at <= 0:
        at = user["last"] + 1_000_000
    closed, s = None, user["current"]
    if s is None or at - s["end"] > GAP_US:
        closed = s
        user["sessions"] += 1
        s = user["current"] = _new_session(user["sessions"], at)
    if kind == "OPEN":
        tab = _add_tab(s, at)
        if tab is None:
            return closed
        if url:
            visit(tab, url, title)
            s["pages"] += 1
        s["active"] = tab["id"]
    elif kind == "CLOSE":
        target = s["active"] if tab_id <= 0 < s["active"] else tab_id
        tab = _find(s, target) if target > 0 else None
        if tab:
            tab["open"] = False
            if s["active"] == target:
                s["active"] = next((t["id"] for t in reversed(s["tabs"]) if t["open"]), -1)
    elif kind == "NAVIGATE":
        tab = _active(s)
        if tab is None:
            tab = _add_tab(s, at)
            if tab is None:
                return closed
            s["active"] = tab["id"]
        if url:
            visit(tab, url, title)
            tab["last"] = at
            s["pages"] += 1
    elif kind == "SWITCH":
        tab = _find(s, tab_id)
        if tab and tab["open"]:
            s["active"] = tab_id
            s["switches"] += 1
            tab["last"] = at
    elif tab := _active(s):
        if kind == "RELOAD":
            tab["loads"] += 1
            s["pages"] += 1
        elif kind in ("BACK", "FORWARD"):
            step(tab, -1 if kind == "BACK" else 1)
        tab["last"] = at
    s["end"] = max(s["end"], at)
    state = next_state(s, at, kind)
    if state != s["state"]:
        move = f"{s['state']}>{state}"
        s["moves"][move] = s["moves"].get(move, 0) + 1
        s["state"] = state
    user["last"] = at
    return closed


def summary(user_id: int, s: dict) -> tuple:
    minutes = ((s["end"] - s["start"]) // 1_000_000) / 60
    return (user_id, s["no"], s["start"], s["end"], s["pages"], len(s["tabs"]), s["most"], s["switches"], minutes, s["state"], dict(s["moves"]))


COLUMNS = [f.split()[0] for f in SESSION_SCHEMA.split(", ")]


def run_user(user_id: int, events: Iterator[tuple]) -> Iterator[tuple]:
    """Sessions of one user's events (kind, tab_id, url, title, micros), in order."""
    user = new_user()
    for event in events:
        if closed := process(user, *event):
            yield summary(user_id, closed)
    if user["current"]:
        yield summary(user_id, user["current"])


def tab_sessions(events: DataFrame) -> DataFrame:
    """SESSION_SCHEMA from tab events (user_id, event_id, type, tab_id, url, title, ts).

    Users are dealt out by hash and sorted by time within their partition, and each partition
    is read once in order, so no user's events are ever gathered in memory.
    """
    from pyspark.sql import functions as F

    rows = events.select("user_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"), "event_id", "type", "tab_id", "url", "title")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user_id, user = None, new_user()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.user_id != user_id:
                    if user["current"]:
                        out.append(summary(user_id, user["current"]))
                    user_id, user = row.user_id, new_user()
                closed = process(user, row.type, int(row.tab_id), row.url or "", row.title or "", int(row.us))
                if closed:
                    out.append(summary(user_id, closed))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        if user["current"]:
            yield pd.DataFrame([summary(user_id, user["current"])], columns=COLUMNS)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, SESSION_SCHEMA)
