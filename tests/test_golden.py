"""The ten made-up visits, with results worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from histlab.functions.times import iso_of_timestamp
from histlab.operators import domains, rules, search, sessions, sets, stats

NOW = datetime(2025, 4, 25)


def by_text_time(history):
    return history.withColumn("last_visit", F.to_timestamp("last_visit_time"))


def test_stats(history10):
    r = stats.history_stats(history10).withColumn("e", iso_of_timestamp(F.col("earliest"))).withColumn("l", iso_of_timestamp(F.col("latest"))).first()
    assert (r["total_urls"], r["total_visits"], r["unique_authorities"], r["top_visits"]) == (10, 316, 10, 83)
    assert (r["e"], r["l"], r["top_title"]) == ("2025-04-20T16:26:40Z", "2025-04-24T20:26:40Z", "Inbox")


def test_categories(history10):
    out = {r["pos"]: (r["category"], r["confidence"]) for r in rules.categorize(history10).collect()}
    names = ["Development", "Search", "Uncategorized", "News", "Streaming", "Shopping", "Email", "Development", "Streaming", "Uncategorized"]
    assert [out[i][0] for i in range(10)] == names
    assert all(out[i][1] == (0 if names[i] == "Uncategorized" else 90) for i in range(10))
    table = {r["category"]: (r["url_count"], r["total_visits"], r["top_domain"]) for r in rules.category_stats(rules.categorize(history10)).collect()}
    assert table["Streaming"] == (2, 74, "open.spotify.com") and table["Development"] == (2, 34, "gitlab.com")
    assert table["Social Media"] == (0, 0, "") and table["Uncategorized"] == (2, 15, "de.wikipedia.org")


def test_second_scheme(history10):
    out = {r["pos"]: r["category"] for r in rules.classify_substrings(history10).collect()}
    assert [out[i] for i in range(10)] == ["Development", "Search", "Education", "News", "Entertainment", "Shopping", "Other", "Development", "Entertainment", "Other"]
    row = stats.analysis(rules.classify_substrings(history10), by_text_time(history10)).first()
    # 43 productive and 74 distracting visits; 89 others over 10 rows and one.
    assert (row["productivity_score"], row["dominant_category"], row["dominant_percent"], row["peak_hour"], row["quiet_hour"], row["peak_day"]) == (36, "Other", 809, 7, 0, 2)


def test_histograms(history10):
    h = by_text_time(history10)
    assert {r["hour"]: r["visits"] for r in stats.hourly_visits(h).where("visits > 0").collect()} == {7: 117, 8: 22, 9: 61, 10: 15, 12: 27, 13: 12, 18: 6, 19: 9, 21: 47}
    assert [r["visits"] for r in stats.weekday_visits(h).orderBy("weekday").collect()] == [24, 110, 117, 0, 6, 12, 47]


def test_domains(history10):
    top = [(r["domain"], r["visit_count"]) for r in domains.top_domains(history10).collect()]
    assert top == [("proton.me", 83), ("spotify.com", 74), ("duckduckgo.com", 61), ("reuters.com", 34), ("gitlab.com", 22), ("etsy.com", 15), ("pypi.org", 12), ("wikipedia.org", 9), ("example.org", 6)]
    legacy = [r["domain"].split(".")[0] for r in domains.top_domains(history10, legacy=True).collect()]
    assert legacy == ["spotify", "gitlab", "duckduckgo", "reuters", "etsy", "wikipedia", "pypi", "example", "proton"]
    roll = {r["suffix"]: (r["visit_count"], r["url_count"]) for r in domains.rollup(history10).collect()}
    assert roll["com"] == (206, 6) and roll["org"] == (27, 3) and roll["spotify.com"] == (74, 2) and roll["me"] == (83, 1)
    assert domains.unique_domains(history10).first()[0] == 9
    assert domains.aggregate(history10, "nowhere.test").first()["url_count"] == -1
    assert domains.lookup(history10, "spotify.com").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("loom rye", []),
        ("domain:spotify.com", [(4, 0.65), (8, 0.65)]),
        ("visits:20 -spotify", [(1, 0.55), (0, 0.50), (3, 0.50), (6, 0.50)]),
        ('"linen apron" AND domain:etsy.com OR tld:org -"step 2" before:2025-12-31', [(5, 0.80), (2, 0.60), (7, 0.60)]),
        ('domain:gitlab.com regex:"issues/[0-9]+" after:2025-01-01 visits:5', [(0, 0.70)]),
        (r'regex:"^https://[a-z]+\.(org|me)/" after:2025-03-01 before:2025-03-31 visits:10', [(6, 0.70)]),
        ("regex:[", []),
    ],
)
def test_search(history10, text, want):
    out = [(r["pos"], round(r["score"], 2)) for r in search.search(history10, text, NOW).collect()]
    assert out == want


def test_search_parser():
    q = search.parse('and x -y or "a b" NOT domain:z visits:12abc after:2024 -')
    assert [(t.kind, t.pattern, t.op) for t in q.terms] == [("substring", "x", "AND"), ("substring", "y", "NOT"), ("substring", "a b", "OR"), ("domain", "z", "NOT")]
    assert (q.min_visits, q.after) == (12, "2024")
    assert len(search.parse(" ".join("abcdefghijklmnopqrst")).terms) == search.MAX_TERMS


def test_sessions(history10):
    out = sessions.sessions(history10, None, "last_visit", "pos").collect()
    assert len(out) == 10 and all(r["page_count"] == 1 and r["minutes"] == 0 and r["state"] == "ACTIVE" for r in out)


def test_merge(history10):
    again = history10.limit(3).selectExpr("pos + 100 as pos", "url", "'other' as title", "visit_count * 2 as visit_count", "0L as typed_count", "last_visit")
    out = {r["pos"]: r for r in sets.merge_by_url(sets.bag_union(history10.select(*again.columns), again)).collect()}
    assert len(out) == 10 and out[0]["visit_count"] == 44 and out[0]["title"] == "Loom: broken shuttle" and out[0]["typed_count"] == 4


def test_rules_file():
    own = rules.load_rules("[social media]\ndomains = a.com, *.b.org\nkeywords = Foo\n[New]\ncolor = #123\npaths[g.com] = /groups/*, /events/*\n; comment\n")
    assert len(own[0].rules) == 23 and own[0].keywords[-1] == "Foo"
    assert own[-1].name == "New" and own[-1].rules[0].pattern == "/groups/*, /events/*" and own[-1].color == "#123"
    assert sum(len(c.rules) for c in rules.built_in()) == 111 and sum(len(c.keywords) for c in rules.built_in()) == 21
    assert sum(len(p.split()) for _, p in rules.SUBSTRING_RULES) == 108
