"""The search language: parser, predicate, scores, ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_nocase, posix_regex
from ..functions.times import iso_of_timestamp
from ..functions.urls import search_host

MAX_TERMS = 16
MAX_RESULTS = 1000


@dataclass(frozen=True)
class Term:
    kind: str  # substring, regex, domain, tld
    pattern: str
    op: str = "AND"  # AND, OR, NOT


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    after: str = ""
    before: str = ""
    min_visits: int = 0


_SPACE = r"[ \t\n\v\f\r]"
_OPERATOR = re.compile(rf"(?i:(and|or|not))(?={_SPACE}|\Z)")
_FILTER = re.compile(rf"-?(?i:(after|before|visits)):([^ \t\n\v\f\r]*)")
_TERM = re.compile(r'(-?)(?i:(regex|domain|tld):)?(?:"([^"]*)"?|([^ \t\n\v\f\r]*))')


def parse(text: str) -> Query:
    """A query: words AND, OR, NOT in any case set the operator of the next term; -x is NOT x."""
    query, at, op = Query(), 0, "AND"
    while len(query.terms) < MAX_TERMS:
        at += len(re.match(rf"{_SPACE}*", text[at:])[0])
        if at >= len(text):
            break
        if m := _OPERATOR.match(text, at):
            op, at = m[1].upper(), m.end()
        elif m := _FILTER.match(text, at):
            name, value, at = m[1].lower(), m[2], m.end()
            if name == "visits":
                number = re.match(r"[+-]?\d+", value[:15])
                query.min_visits = int(number[0]) if number else 0
            else:
                setattr(query, name, value)
        elif text[at:] == "-":
            break
        else:
            m = _TERM.match(text, at)
            value = m[3] if m[3] is not None else m[4]
            query.terms.append(Term((m[2] or "substring").lower(), value, "NOT" if m[1] else op))
            op, at = "AND", m.end()
    return query


def hits(term: Term, url: Column, title: Column) -> tuple[Column, Column]:
    """Whether the URL and the title match, before any negation."""
    no = F.lit(False)
    if term.kind == "substring":
        return contains_nocase(url, term.pattern), (title != "") & contains_nocase(title, term.pattern)
    if term.kind == "regex":
        pattern = posix_regex(term.pattern)
        return (no, no) if pattern is None else (url.rlike(pattern), (title != "") & title.rlike(pattern))
    host, wanted = search_host(url), term.pattern.lower()
    if term.kind == "domain":
        return (host == wanted) | (host.endswith("." + wanted) & (F.length(host) > len(wanted) + 1)), no
    return host.contains(".") & (F.regexp_extract(host, r"([^.]*)$", 1) == wanted), no


def passes(query: Query, when: Column, visits: Column) -> Column:
    """The filters; dates compare as text, and rows without a time pass them."""
    out = F.lit(True)
    if query.min_visits > 0:
        out = out & (visits >= query.min_visits)
    timed = F.coalesce(when, F.lit("")) != ""
    if query.after:
        out = out & (~timed | (when >= query.after))
    if query.before:
        out = out & (~timed | (when <= query.before))
    return out


def score(url_hit: Column, title_hit: Column, visits: Column, seen: Column, now: datetime) -> Column:
    """Hundredths: where the hit is, how often the page was visited, how long ago; at most 100."""
    place = F.when(url_hit & title_hit, 40).when(title_hit, 30).when(url_hit, 20).otherwise(0)
    often = F.lit(0)
    for least, points in ((1, 5), (5, 10), (10, 15), (20, 20), (50, 25), (100, 30)):
        often = F.when(visits >= least, points).otherwise(often)
    days = F.call_function("div", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(seen.cast("timestamp")), F.lit(86400).cast("long"))
    recent = F.lit(5)
    for most, points in ((365, 10), (90, 15), (30, 20), (7, 25), (1, 30)):
        recent = F.when(days <= most, points).otherwise(recent)
    return F.least(F.lit(100), place + often + F.when(seen.isNotNull(), recent).otherwise(0))


def search(history: DataFrame, text: str | Query, now: datetime, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """Rows that match, best first, with score, match_count, url_hit and title_hit.

    The predicate is one column expression with the cheap filters first; it reaches the scan.
    At most ``max_results`` rows are taken in the order of pos before they are ranked; None
    takes all. Ranking keeps that order among equal scores.
    """
    query = parse(text) if isinstance(text, str) else text
    url, title = F.col("url"), F.coalesce(F.col("title"), F.lit(""))
    when = F.col("last_visit_time") if "last_visit_time" in history.columns else iso_of_timestamp(F.col("last_visit"))
    any_url, any_title, count, matched = F.lit(False), F.lit(False), F.lit(0), None
    for term in query.terms:
        u, t = hits(term, url, title)
        m = ~(u | t) if term.op == "NOT" else u | t
        matched = m if matched is None else matched | m if term.op == "OR" else matched & m
        any_url, any_title, count = any_url | u, any_title | t, count + m.cast("int")
    found = history.where(passes(query, when, F.col("visit_count")))
    if matched is not None:
        found = found.where(matched)
    if max_results is not None:
        found = found.orderBy("pos").limit(max_results)
    found = found.withColumns({"url_hit": any_url, "title_hit": any_title, "match_count": count})
    points = score(F.col("url_hit"), F.col("title_hit"), F.col("visit_count"), F.col("last_visit"), now)
    return found.withColumn("score", points / 100.0).orderBy(F.desc("score"), "pos")
