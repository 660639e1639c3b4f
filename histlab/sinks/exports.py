"""Exports of the history: JSON envelope, CSV, Markdown, HTML, and console text.

Whole-table exports are written by the executors; the single-file forms stream rows to the
driver one partition at a time, and reports take a bounded number of rows.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import NEVER, iso_of_timestamp
from ..functions.web import html_escape
from ..operators.stats import history_stats

COLUMNS = ("url", "title", "visit_count", "typed_count", "last_visit_time")
MARKDOWN_ROWS, HTML_ROWS, SUMMARY_ROWS = 200, 500, 10
UNTITLED = "(untitled)"


def now_text(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def rows_to_export(history: DataFrame) -> DataFrame:
    """COLUMNS and pos; absent texts are empty."""
    when = F.col("last_visit_time") if "last_visit_time" in history.columns else iso_of_timestamp(F.col("last_visit"))
    return history.select(
        "pos", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
        F.coalesce("typed_count", F.lit(0)).alias("typed_count"), F.coalesce(when, F.lit("")).alias("last_visit_time"),
    )


def _ordered(history: DataFrame) -> Iterator:
    return rows_to_export(history).orderBy("pos").select(*COLUMNS).toLocalIterator(prefetchPartitions=True)


def stats_record(history: DataFrame) -> dict:
    """The statistics as exports name them."""
    r = history_stats(history).select("*", iso_of_timestamp(F.col("earliest")).alias("first"), iso_of_timestamp(F.col("latest")).alias("last")).first()
    return {
        "total_urls": r["total_urls"], "total_visits": r["total_visits"], "unique_domains": r["unique_authorities"], "earliest_visit": r["first"] or NEVER,
        "latest_visit": r["last"] or NEVER, "most_visited_url": r["top_url"] or "", "most_visited_title": r["top_title"] or "", "most_visited_count": r["top_visits"] or 0,
    }


def write_json(history: DataFrame, path: str | Path, now: datetime | None = None) -> int:
    """One file with statistics and all rows; gives the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        start = json.dumps({"success": True, "timestamp": now_text(now), "error": None, "stats": stats_record(history)}, ensure_ascii=False, indent=2)
        out.write(start[:-2] + ',\n  "data": [')
        for row in _ordered(history):
            out.write(("," if n else "") + "\n    " + json.dumps(row.asDict(), ensure_ascii=False))
            n += 1
        out.write("\n  ]\n}\n")
    return n


def write_extension_json(visits: DataFrame, path: str | Path, now: datetime | None = None) -> int:
    """One file as the browser extension writes it, from (url, title, ts, incognito)."""
    counts = visits.agg(F.count("*").alias("n"), F.count_if("incognito").alias("i"), iso_of_timestamp(F.min("ts")).alias("first"), iso_of_timestamp(F.max("ts")).alias("last")).first()
    stats = {"total_urls": counts["n"], "total_incognito": counts["i"], "total_normal": counts["n"] - counts["i"], "tracking_started": counts["first"] or "unknown", "last_updated": counts["last"] or "unknown"}
    head = {"success": True, "timestamp": now_text(now), "error": None, "source": "incognito-history-tracker-extension", "version": "2.0.0", "stats": stats}
    rows = visits.orderBy("ts").select("url", "title", iso_of_timestamp(F.col("ts")).alias("timestamp"), "incognito")
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "data": [')
        for row in rows.toLocalIterator():
            record = row.asDict() | {"visit_count": 1, "typed_count": 0, "last_visit_time": row["timestamp"]}
            out.write(("," if n else "") + "\n    " + json.dumps(record, ensure_ascii=False))
            n += 1
        out.write("\n  ]\n}\n")
    return n


def csv_field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def write_csv(history: DataFrame, path: str | Path, header: bool = True) -> int:
    """One file with byte order mark and CRLF, quotes only where they are needed."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("﻿" + (",".join(COLUMNS) + "\r\n" if header else ""))
        for row in _ordered(history):
            out.write(",".join(csv_field(str(v)) for v in row) + "\r\n")
            n += 1
    return n


def write_csv_parts(history: DataFrame, path: str) -> None:
    """A folder of CSV files, written by the executors."""
    rows_to_export(history).select(*COLUMNS).write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", mode="error")


def write_json_lines(history: DataFrame, path: str) -> None:
    rows_to_export(history).select(*COLUMNS).write.json(path, mode="error")


_MARKDOWN = str.maketrans({"|": "\\|", "\\": "\\\\", "[": "\\[", "]": "\\]", "*": "\\*", "_": "\\_", "`": "\\`", "\n": " ", "\r": None})


def markdown_escape(text: str, most: int = 0) -> str:
    """Signs of Markdown escaped; at most ``most`` characters (0: all) and dots where there were more."""
    cut = 0 < most < len(text)
    return (text[:most] if cut else text).translate(_MARKDOWN) + ("..." if cut else "")


def write_markdown(history: DataFrame, path: str | Path, categories: DataFrame | None = None, now: datetime | None = None) -> None:
    """Statistics, categories (a table of rules.category_stats) and the first MARKDOWN_ROWS rows."""
    s = stats_record(history)
    shown = rows_to_export(history).orderBy("pos").limit(MARKDOWN_ROWS).select(*COLUMNS).collect()
    out = ["# Browser History Report", "", f"> Generated on {now_text(now)} — {s['total_urls']} entries", "", "## Table of Contents", "", "- [Statistics](#statistics)"]
    out += ["- [Categories](#categories)"] * (categories is not None)
    out += ["- [History Entries](#history-entries)", "", "---", "", "## Statistics", "", "| Metric | Value |", "|--------|-------|"]
    out += [f"| {name} | {s[key]} |" for name, key in (("Total URLs", "total_urls"), ("Total Visits", "total_visits"), ("Unique Domains", "unique_domains"), ("Earliest Visit", "earliest_visit"), ("Latest Visit", "latest_visit"))]
    if s["most_visited_title"]:
        out.append(f"| Most Visited | {markdown_escape(s['most_visited_title'], 50)} ({s['most_visited_count']} visits) |")
    if categories is not None:
        rows = categories.collect()
        out += ["", "## Categories", "", "| Category | URLs | Total Visits | Top Domain |", "|----------|------|--------------|------------|"]
        rows.sort(key=lambda r: (r["category_idx"] < 0, r["category_idx"]))
        out += [f"| {markdown_escape(r['category'])} | {r['url_count']} | {r['total_visits']} | {markdown_escape(r['top_domain'], 30)} |" for r in rows if r["url_count"]]
        known = sum(r["url_count"] for r in rows if r["category_idx"] >= 0)
        out += ["", f"**Categorized:** {known} | **Uncategorized:** {s['total_urls'] - known}"]
    out += ["", "## History Entries", ""]
    if s["total_urls"] > MARKDOWN_ROWS:
        out += [f"> Showing first {MARKDOWN_ROWS} of {s['total_urls']} entries", ""]
    out += ["| # | Title | URL | Visits | Last Visit |", "|---|-------|-----|--------|------------|"]
    for i, r in enumerate(shown, 1):
        title = markdown_escape(r["title"], 40) if r["title"] else "*No title*"
        address = r["url"].replace("(", "%28").replace(")", "%29")
        out.append(f"| {i} | {title} | [link]({address}) | {r['visit_count']} | {r['last_visit_time']} |")
    Path(path).write_text("\n".join([*out, "", "---", "", "*Generated by histlab*", ""]), encoding="utf-8")


_SORT = """
function sortTable(n) {
  const body = document.querySelector('#entries tbody'), rows = [...body.rows];
  const up = body.dataset.by === String(n) && body.dataset.up !== '1';
  const value = r => n === 3 ? parseInt(r.cells[n].textContent) || 0 : r.cells[n].textContent.toLowerCase();
  rows.sort((a, b) => { const x = value(a), y = value(b); return (x < y ? -1 : x > y ? 1 : 0) * (up ? 1 : -1); });
  rows.forEach(r => body.appendChild(r)); body.dataset.by = n; body.dataset.up = up ? '1' : '0';
}
"""


def write_html(history: DataFrame, path: str | Path, categories: DataFrame | None = None, now: datetime | None = None) -> None:
    """A page of its own: cards, bars per category, and the first HTML_ROWS rows in a table to sort."""
    s, e = stats_record(history), html.escape
    shown = rows_to_export(history).orderBy("pos").limit(HTML_ROWS)
    shown = shown.select(html_escape(F.when(F.col("title") == "", UNTITLED).otherwise(F.col("title"))).alias("title"), "url", "visit_count", "last_visit_time").collect()
    out = ["<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8"><title>Browser History Report</title>']
    out.append("<style>body{font-family:sans-serif;margin:2em}.card{display:inline-block;padding:1em;margin:.5em;border:1px solid #ccc}.bar{height:1em}td,th{padding:.3em;text-align:left}</style></head><body>")
    out.append(f"<h1>Browser History Report</h1><p>{now_text(now)}</p>")
    for name, key in (("URLs", "total_urls"), ("Visits", "total_visits"), ("Domains", "unique_domains")):
        out.append(f'<div class="card"><b>{s[key]}</b><br>{name}</div>')
    if categories is not None:
        rows = [r for r in categories.collect() if r["url_count"]]
        most = max((r["url_count"] for r in rows), default=1)
        out.append("<h2>Categories</h2>")
        for r in sorted(rows, key=lambda r: (r["category_idx"] < 0, r["category_idx"])):
            out.append(f'<div>{e(r["category"])} ({r["url_count"]})<div class="bar" style="width:{r["url_count"] * 100 // most}%;background:#3498DB"></div></div>')
    out.append('<h2>Entries</h2><table id="entries"><thead><tr>')
    out += [f'<th onclick="sortTable({i})">{name}</th>' for i, name in enumerate(("#", "Title", "URL", "Visits", "Last Visit"))]
    out.append("</tr></thead><tbody>")
    for i, r in enumerate(shown, 1):
        short = r["url"] if len(r["url"]) <= 60 else r["url"][:57] + "..."
        out.append(f'<tr><td>{i}</td><td>{r["title"]}</td><td><a href="{e(r["url"])}">{e(short)}</a></td><td>{r["visit_count"]}</td><td>{e(r["last_visit_time"])}</td></tr>')
    out.append(f"</tbody></table><script>{_SORT}</script></body></html>")
    Path(path).write_text("\n".join(out), encoding="utf-8")


def summary(history: DataFrame) -> str:
    """Console text: statistics and the first SUMMARY_ROWS rows."""
    s = stats_record(history)
    out = [f"{k.replace('_', ' ')}: {v}" for k, v in s.items()]
    for r in rows_to_export(history).orderBy("pos").limit(SUMMARY_ROWS).collect():
        out.append(f"  {r['title'] or UNTITLED} | {r['url']} | {r['visit_count']} | {r['last_visit_time']}")
    return "\n".join(out)


def table_text(df: DataFrame, most: int) -> str:
    """Console text of the first rows of a small result."""
    rows = df.limit(most).collect()
    return "\n".join(["  " + " | ".join(df.columns), *("  " + " | ".join(str(v) for v in r) for r in rows)])
