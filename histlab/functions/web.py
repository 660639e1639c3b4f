"""Page metadata, and how times and addresses are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata of a page: name of the field, and the attribute and value that mark its tag (fixed values).
META = {
    "description": ("name", "description"),
    "keywords": ("name", "keywords"),
    "og_title": ("property", "og:title"),
    "og_image": ("property", "og:image"),
    "og_type": ("property", "og:type"),
}


def page_metadata(html: Column) -> Column:
    """Struct of META, canonical and lang; empty where a page has none."""

    def of_tag(tag: str, attribute: str, value: str, wanted: str) -> Column:
        head = rf"""(?is)<{tag}\b(?=[^>]*\b{attribute}\s*=\s*["']?{value}["'\s/>])[^>]*?\b{wanted}\s*=\s*"""
        quoted = F.regexp_extract(html, head + r"""(["'])(.*?)\1""", 2)
        return F.when(quoted != "", quoted).otherwise(F.regexp_extract(html, head + r"""([^"'\s>]+)""", 1))

    fields = {name: of_tag("meta", *mark, "content") for name, mark in META.items()}
    fields["canonical"] = of_tag("link", "rel", "canonical", "href")
    fields["lang"] = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def relative_time(ts: Column, now: Column) -> Column:
    """just now, minutes or hours ago, then day and time, and only the date in other years."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    whole = lambda by: F.floor(seconds / by).cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h ago")))
        .when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d HH:mm"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def shortened(c: Column, most: int = 55) -> Column:
    """At most ``most`` characters, the last three being dots where there were more."""
    return F.when(F.length(c) > most, F.concat(c.substr(1, most - 3), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c
