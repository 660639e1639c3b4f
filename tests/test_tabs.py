import datetime
import json
import random

import duckdb
from pyspark.sql import functions as F

from histlab.operators import tabs
from histlab.plans.oracle import oracle_sql
from histlab.schema import EVENT_KINDS

BASE = 10**15


def run(events):
    return list(tabs.run_user(1, iter(events)))


def named(out):
    return [dict(zip(tabs.COLUMNS, r, strict=True)) for r in out]


def test_states():
    rows = [(t, "NAVIGATE", 0, u) for t, u in ((0, "a"), (10, "b"), (20, "c"), (30, "d"))] + [(40, "SWITCH", 99, ""), (50, "RELOAD", 0, ""), (1850, "NAVIGATE", 0, "e"), (3651, "NAVIGATE", 0, "f")]
    one, two = named(run([(k, tab, u, u, BASE + t * 1_000_000) for t, k, tab, u in rows]))
    assert (one["page_count"], one["state"], one["tab_count"], one["max_concurrent_tabs"], one["tab_switches"]) == (6, "DEEP_BROWSE", 1, 1, 0)
    assert one["minutes"] == 1850 / 60 and one["transitions"] == {"ACTIVE>DEEP_BROWSE": 2, "DEEP_BROWSE>ACTIVE": 1}
    assert (two["page_count"], two["state"], two["start_us"]) == (1, "ACTIVE", BASE + 3651 * 10**6)


def test_missing_time_and_late_events():
    user = tabs.new_user()
    tabs.process(user, "OPEN", 0, "a", "", BASE)
    tabs.process(user, "OPEN", 0, "b", "", 0)
    assert user["current"]["end"] == BASE + 1_000_000
    tabs.process(user, "NAVIGATE", 0, "c", "", BASE - 5)
    assert user["current"]["end"] == BASE + 1_000_000 and user["sessions"] == 1


def test_navigation_stack():
    tab = {"stack": [], "at": -1, "url": "", "title": "", "referrer": "", "loads": 0}
    for u in "abc":
        tabs.visit(tab, u, u)
    assert tabs.step(tab, -1) and tabs.step(tab, -1) and not tabs.step(tab, -1) and tab["url"] == "a"
    tabs.visit(tab, "d", "d")
    assert tab["stack"] == ["a", "d"] and not tabs.step(tab, 1) and tab["referrer"] == "a"
    for i in range(300):
        tabs.visit(tab, str(i), "")
    assert len(tab["stack"]) == tabs.MAX_CHAIN and tab["stack"][-1] == "299"


def test_close_selects_the_last_open_tab():
    user = tabs.new_user()
    for u in "abc":
        tabs.process(user, "OPEN", 0, u, "", BASE)
    tabs.process(user, "CLOSE", 3, "", "", BASE)
    assert user["current"]["active"] == 2 and user["current"]["most"] == 3
    tabs.process(user, "SWITCH", 3, "", "", BASE)
    assert user["current"]["switches"] == 0
    tabs.process(user, "SWITCH", 1, "", "", BASE)
    assert user["current"]["active"] == 1 and user["current"]["switches"] == 1


def events(spark, n=400, users=5):
    rng = random.Random(4)
    rows = [(rng.randrange(users), i, rng.choice(tabs.EVENTS), rng.randint(0, 4), rng.choice(["", "u1", "u2"]), "t", BASE + rng.randrange(200_000) * 1_000_000) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, type string, tab_id int, url string, title string, us long").withColumn("ts", F.timestamp_micros("us"))


def test_batch(spark):
    rows, df = events(spark)
    want = []
    for user in range(5):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[6], r[1]))
        want += tabs.run_user(user, iter([(r[2], r[3], r[4], r[5], r[6]) for r in own]))
    got = [tuple(r) for r in tabs.tab_sessions(df).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_batch_with_no_events(spark):
    _, df = events(spark)
    assert tabs.tab_sessions(df.where("user_id < 0")).count() == 0


def test_sql_of_the_machine():
    """The SQL against the machine, on users whose sessions are long, and one with more tabs than there may be."""
    rng = random.Random(8)
    start, rows, at = datetime.datetime(2024, 1, 1), [], dict.fromkeys(range(12), 0)
    for event_id in range(3000):
        user = event_id % 12
        at[user] += rng.choice([1, 5, 20, 400, 1800, 1801] if user else [1])
        likely = [1, 9, 0.3, 1, 0.3] if user % 3 == 1 else [3, 2, 8, 1, 1] if user % 3 == 2 else [3, 2, 2, 1, 0.05 if user == 0 else 2]
        rows.append((event_id, start + datetime.timedelta(seconds=at[user]), user, rng.choices(["click", "view", "signup", "purchase", "error"], likely)[0]))
    pages = [(0, "http://a/", "<title>a</title>"), (1, "", ""), (2, "http://b/", "")]
    duck = duckdb.connect()
    duck.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar)")
    duck.sql("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into events values (?, ?, ?, ?)", rows)
    duck.executemany("insert into pages values (?, ?, ?)", pages)
    result = duck.sql(oracle_sql()["tab_state_machine"])
    got = sorted(tuple(json.loads(r[result.columns.index(c)]) if c == "transitions" else r[result.columns.index(c)] for c in tabs.COLUMNS) for r in result.fetchall())
    want = []
    for user in at:
        own = sorted((ts, i, kind) for i, ts, u, kind in rows if u == user)
        events = ((EVENT_KINDS[kind], i % 5 + 1, pages[i % 3][1], "", (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)) for ts, i, kind in own)
        want += tabs.run_user(user, events)
    assert got == sorted(want, key=lambda r: r[:2])
    assert {"DEEP_BROWSE", "RAPID_FIRE"} <= {r[9] for r in want} and max(r[5] for r in want) == tabs.MAX_TABS
