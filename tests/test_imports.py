"""Imports of files of every kind."""

import json
import sqlite3

import pytest

from histlab.sources import bookmarks, config, csv_files, discover, wire
from histlab.sources.importer import auto_import
from histlab.sources.sqlite_source import read_chromium, read_firefox

CSV = {
    "chrome.csv": (
        'url,title,visit_count,typed_count,last_visit_time\nhttps://a.com/,A,15,3,2026-04-27T13:38:10Z\nhttps://b.com/,"B, b",8,2,2026-04-27 12:00:00\n'
        'https://c.com/,"javascript - ""How"" to?",0,x,\nno address,x,1,1,\n',
        [("https://a.com/", "A", 15, 3, "2026-04-27T13:38:10Z"), ("https://b.com/", "B, b", 8, 2, "2026-04-27T12:00:00Z"), ("https://c.com/", 'javascript - "How" to?', 1, 0, "")],
    ),
    "chromium.csv": ("url,title,visits,time\nhttps://a.com/,A,1,13380123456000000\n", [("https://a.com/", "A", 1, 0, "2024-12-31T12:57:36Z")]),
    "plain.csv": ("https://a.com/,A,3,1745757490\nabout:blank,B,2,1745757400\n", [("https://a.com/", "A", 3, 0, "2025-04-27T12:38:10Z"), ("about:blank", "B", 2, 0, "2025-04-27T12:36:40Z")]),
    "semi.csv": (
        '"address";"name";"visits";"date"\n"https://a.com/";"A\nline";"4";"27/04/2026 13:38:10"\n"https://b.com/";"B";"5";"26/04/2026 18:30:00"\n',
        [("https://a.com/", "A\nline", 4, 0, "2026-04-27T13:38:10Z"), ("https://b.com/", "B", 5, 0, "2026-04-26T18:30:00Z")],
    ),
    "tab.tsv": ("URL\tTitle\tVisits\tTimestamp\nhttps://a.com/\tA\t2\t1745757490\n", [("https://a.com/", "A", 2, 0, "2025-04-27T12:38:10Z")]),
    "us.csv": (
        "url,title,visits,date\nhttps://a.com/,A,1,04/27/2026 1:38:10 PM\nhttps://b.com/,B,1,04/26/2026 12:30:00 AM\nhttps://c.com/,C,1,04/25/2026\nhttps://d.com/,D,1,soon\n",
        [("https://a.com/", "A", 1, 0, "2026-04-27T13:38:10Z"), ("https://b.com/", "B", 1, 0, "2026-04-26T00:30:00Z"), ("https://c.com/", "C", 1, 0, "2026-04-25T00:00:00Z"), ("https://d.com/", "D", 1, 0, "soon")],
    ),
}


@pytest.mark.parametrize("name", CSV)
def test_csv(spark, tmp_path, name):
    text, want = CSV[name]
    path = tmp_path / name
    path.write_text("﻿" + text, encoding="utf-8")
    rows = auto_import(spark, str(path)).orderBy("pos").collect()
    assert [(r["url"], r["title"], r["visit_count"], r["typed_count"], r["last_visit_time"]) for r in rows] == want


def test_csv_date_far_down(spark, tmp_path):
    late = "".join(f"https://a.com/{i},{'x' * 40},1,\n" for i in range(400))
    path = tmp_path / "late.csv"
    path.write_text("url,title,visits,date\nhttps://z.com/,Z,1,5/6/2026\nno address,x,1,1745757490\n" + late + "https://b.com/,B,1,27/04/2026 13:38:10\nhttps://c.com/,C,1,05/04/2026\n")
    times = {r["url"]: (r["last_visit_time"], r["last_visit"]) for r in csv_files.read_csv(spark, str(path)).collect()}
    assert times["https://b.com/"][0] == "2026-04-27T13:38:10Z" and times["https://b.com/"][1] is not None
    assert times["https://c.com/"][0] == "2026-04-05T00:00:00Z"
    assert times["https://z.com/"][0] == "5/6/2026" and times["https://a.com/0"][0] == ""


def test_date_format_column(spark):
    from pyspark.sql import functions as F

    from histlab.functions.times import date_format, detect_date_format

    texts = ["2026-04-27", "1745757490", "1745757490000", "13380123456000000", "12345678", "04/27/2026", "27/04/2026", "27.04.2026", "5/6/2026", "13/13/2026", "", "99.99.2026", "x", "01-02-2026", "12/31/26", "2026-04-27T10:00:00Z"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", date_format(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == {x: detect_date_format(x) for x in texts}


def test_latin1_csv(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("url,title\nhttps://a.com/,café\n".encode("latin-1"))
    assert csv_files.read_csv(spark, str(path)).first()["title"] == "café"


def test_delimiters():
    assert csv_files.detect_delimiter("a|b|c\n1|2|3\n") == "|"
    assert csv_files.detect_delimiter('"a,b,c";d\n"x,y,z";e\n') == ";"
    assert csv_files.detect_delimiter("nothing") == ","


NESTED = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p><DT><H3>Bookmarks Bar</H3>
<DL><p><DT><A HREF="https://g.com/" ADD_DATE="1745757490">Google</A>
<DT><A HREF='https://h.com/?a=1&amp;b=2' ADD_DATE="1745757490" LAST_VISIT="1745757600">Git &amp; Hub &lt;x&gt;</A>
<DT><H3>Dev</H3><DL><p><DT><a href=https://m.com/ add_date=13380123456000000>MDN</a></DL><p>
<DT><A HREF="https://after.com/">After</A></DL><p>
<!-- <A HREF="https://no.com/">no</A> -->
<DT><A>nothing</A><DT><A HREF="">nothing</A></DL>"""


def test_bookmarks(spark, tmp_path):
    path = tmp_path / "b.html"
    path.write_text(NESTED)
    rows = [(r["url"], r["title"], r["last_visit_time"]) for r in bookmarks.read_bookmarks(spark, str(path)).collect()]
    assert rows == [
        ("https://g.com/", "[Bookmarks Bar] Google", "2025-04-27T12:38:10Z"),
        ("https://h.com/?a=1&b=2", "[Bookmarks Bar] Git & Hub <x>", "2025-04-27T12:40:00Z"),
        ("https://m.com/", "[Dev] MDN", "2024-12-31T12:57:36Z"),
        ("https://after.com/", "[Bookmarks Bar] After", ""),
    ]
    assert auto_import(spark, str(path)).count() == 4
    assert list(bookmarks.parse("no bookmarks <a href=x>y</a>")) == []
    deep = "".join(f"<DL><DT><H3>L{i}</H3>" for i in range(1, 11)) + "<DL><DT><A HREF='u:1'>Deep Link</A>"
    assert [r[1] for r in bookmarks.parse(deep)] == ["[L10] Deep Link"]
    assert [r[1] for r in bookmarks.parse("<DT><A HREF='u:1' X=1>A b\n<DT><A HREF=u:2>C</A>")] == ["A b", "C"]


def test_extension_json(spark, tmp_path):
    path = tmp_path / "x.json"
    rows = [{"url": "https://a.com/", "title": 'q "x" {y}', "timestamp": "2026-04-27T13:38:10.000Z", "incognito": True, "visit_count": 9}, {"url": "", "title": "no"}]
    path.write_text(json.dumps({"success": True, "source": "incognito-history-tracker-extension", "data": rows}))
    (r,) = auto_import(spark, str(path)).collect()
    assert (r["title"], r["visit_count"], r["typed_count"], r["incognito"]) == ('[INCOGNITO] q "x" {y}', 1, 0, True) and r["last_visit"].year == 2026
    path.write_text(json.dumps({"data": [{"url": "https://a.com/", "title": "t", "visit_count": 9, "typed_count": 2, "last_visit_time": "2026-04-27T13:38:10Z"}]}))
    (r,) = auto_import(spark, str(path)).collect()
    assert (r["title"], r["visit_count"], r["typed_count"]) == ("t", 9, 2)


@pytest.fixture()
def home(tmp_path):
    chrome = tmp_path / ".config/google-chrome"
    for profile, rows in (("Default", [(1, "https://a.com/", "A", 3, 1, 13380000000000000), (2, "https://b.com/", None, 1, 0, 0)]), ("Profile 2", [(1, "https://a.com/", "Other", 7, 0, 13380000001000000)])):
        (chrome / profile).mkdir(parents=True)
        db = sqlite3.connect(chrome / profile / "History")
        db.execute("create table urls(id integer primary key, url text, title text, visit_count integer, typed_count integer, last_visit_time integer, hidden integer default 0)")
        db.executemany("insert into urls(id, url, title, visit_count, typed_count, last_visit_time) values (?,?,?,?,?,?)", rows)
        db.commit()
        db.close()
    fox = tmp_path / ".mozilla/firefox/x1.default"
    fox.mkdir(parents=True)
    db = sqlite3.connect(fox / "places.sqlite")
    db.execute("create table moz_places(id integer primary key, url text, title text, visit_count integer, typed integer)")
    db.execute("create table moz_historyvisits(place_id integer, visit_date integer)")
    db.executemany("insert into moz_places values (?,?,?,?,?)", [(1, "https://f.com/", "F", 2, 1), (2, "https://never.com/", "N", 0, 0)])
    db.executemany("insert into moz_historyvisits values (?,?)", [(1, 1_735_000_000_000_000), (1, 1_736_000_000_000_000)])
    db.commit()
    db.close()
    return tmp_path


def test_databases(spark, home):
    found = discover.scan(home, "linux")
    assert [(p.browser, p.profile) for p in found] == [("chrome", "Default"), ("chrome", "Profile 2"), ("firefox", "default")]
    path = found[0].path
    rows = {r["url"]: r for r in read_chromium(spark, [path]).collect()}
    assert rows["https://a.com/"]["last_visit_time"] == "2024-12-30T02:40:00Z" and rows["https://b.com/"]["last_visit"] is None and rows["https://b.com/"]["title"] == ""
    edge = 13380000000000000
    assert read_chromium(spark, [path], edge).count() == 0 and read_chromium(spark, [path], edge, inclusive=True).count() == 1
    fox = read_firefox(spark, [found[2].path]).collect()
    assert [(r["url"], r["last_visit_raw"], r["typed_count"]) for r in fox] == [("https://f.com/", 1_736_000_000_000_000, 1)]
    assert read_firefox(spark, [found[2].path], 1_735_500_000_000_000).count() == 1 and read_firefox(spark, [found[2].path], 1_737_000_000_000_000).count() == 0
    assert discover.read_profiles(spark, found).count() == 4 and discover.sources_table(spark, found).count() == 3
    merged = {r["url"]: r["visit_count"] for r in discover.read_all_browsers(spark, home, platform="linux").collect()}
    assert merged == {"https://a.com/": 7, "https://b.com/": 1, "https://f.com/": 2}
    assert discover.browser_type(" Google Chrome ") == "chrome" and discover.browser_type("x") is None
    assert discover.read_profiles(spark, []).count() == 0


def test_filter_reaches_the_database(spark, home):
    plan = read_chromium(spark, [discover.scan(home, "linux")[0].path], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "Filter" not in plan or "BatchScan" in plan


def test_config(tmp_path):
    other = tmp_path / "inc.conf"
    other.write_text("[inc]\nx = 1.5\n")
    text = f"""top = yes
[ general ]
default_days = 30 ; inline
browser_order = a, b
list = a,b
name = "q # kept"
color = #FF5733
long = one \\
 two \\
 three
no_value
eq = key=value=pair
home = ${{HOME_X}}/f${{NOPE}}
@include {other}
@include {other}
[general]
default_days = 99
"""
    c = config.parse(text, {"HOME_X": "/h"})
    assert c.get("general", "default_days") == 30 and c.find("general", "browser_order").kind == "string" and c.get("general", "list") == ["a", "b"]
    assert c.get("general", "name") == "q # kept" and c.get("general", "color") == "" and c.get("general", "eq") == "key=value=pair" and c.get("general", "home") == "/h/f"
    assert c.get("general", "long").split() == ["one", "two", "three"] and c.get("", "top") is True and c.get("inc", "x") == 1.5 and len(c.includes) == 1
    assert c.sections == ["general", "inc"] or c.sections == ["general", "inc", "general"]
    rules = [config.Rule("general", "default_days", "int", low=1, high=20), config.Rule("general", "gone", required=True), config.Rule("x", "y", default="7"), config.Rule("general", "eq", choices=("a",))]
    assert len(c.validate(rules)) == 3 and c.apply_defaults(rules).get("x", "y") == 7


def test_wire(spark, tmp_path):
    def event(kind, tab, step, url, title):
        return bytes([kind, tab]) + step.to_bytes(8, "little", signed=True) + bytes([len(url)]) + url + bytes([len(title)]) + title

    data = event(2, 0, 5_000_000, b"http://a", b"A") + event(8, 4, -2_000_000, b"", b"") + b"\x00" * 5
    assert list(wire.decode(data)) == [(0, "NAVIGATE", 1, "http://a", "A", 10**15 + 6_000_000), (1, "CLOSE", 5, "", "", 10**15 + 9_000_000)]
    path = tmp_path / "log.bin"
    path.write_bytes(data)
    assert wire.read_events(spark, str(path)).count() == 2 and list(wire.decode(b"")) == []


def test_rows_in_the_log_of_a_database_are_read(spark, tmp_path):
    """A browser that still runs has its last rows in the write-ahead log only."""
    import sqlite3

    from histlab.sources.sqlite_source import read_chromium

    path = str(tmp_path / "History")
    db = sqlite3.connect(path)
    db.execute("pragma journal_mode = wal")
    db.execute("create table urls (id integer primary key, url text, title text, visit_count integer, typed_count integer, last_visit_time integer)")
    db.execute("insert into urls values (1, 'https://bakery.net/', 'Bakery', 3, 1, 13390000000000000)")
    db.commit()
    assert (tmp_path / "History-wal").stat().st_size > 0
    assert [r["url"] for r in read_chromium(spark, [path]).collect()] == ["https://bakery.net/"]
    db.close()
