"""Epochs, ISO text and dates of imports as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between 1601 and 1970 (fixed value).
CHROMIUM_SHIFT = 11_644_473_600
FORMATS = ("chromium", "firefox", "unix_ms", "unix")
NEVER = "(never)"


def _div(a: Column, by: int) -> Column:
    """Whole division that truncates toward zero."""
    return F.call_function("div", a, F.lit(by).cast("long"))


def unix_seconds(raw: Column, ts_format: str | Column) -> Column:
    """Raw time of an epoch as Unix seconds; division truncates."""

    def of(kind: str) -> Column:
        shifted = {"chromium": raw - CHROMIUM_SHIFT * 1_000_000, "firefox": raw, "unix_ms": raw, "unix": raw}[kind]
        step = {"chromium": 1_000_000, "firefox": 1_000_000, "unix_ms": 1000, "unix": 1}[kind]
        return _div(shifted.cast("long"), step) if step > 1 else shifted.cast("long")

    if isinstance(ts_format, str):
        return of(ts_format)
    out = F.lit(None).cast("long")
    for kind in FORMATS:
        out = F.when(ts_format == kind, of(kind)).otherwise(out)
    return out


def iso_text(seconds: Column) -> Column:
    """Unix seconds as YYYY-MM-DDTHH:MM:SSZ (in a UTC session)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_of_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def chromium_iso(raw: Column) -> Column:
    """ISO text of a Chromium time; no time becomes NEVER."""
    return F.when(F.coalesce(raw, F.lit(0)) == 0, NEVER).otherwise(iso_text(unix_seconds(raw, "chromium")))


def detect_date_format(text: str) -> str | None:
    """iso, chromium, unix_ms, unix, us, eu, or None, from one value."""
    n = len(text)
    if n >= 10 and text[4] == "-" and text[7] == "-":
        return "iso"
    if n and text.isascii() and text.isdigit():
        for least, kind in ((16, "chromium"), (13, "unix_ms"), (9, "unix")):
            if n >= least:
                return kind
    if n >= 8 and text[2] in "/.":
        first, second = _leading_int(text), _leading_int(text[3:])
        if text[2] == "/" and 1 <= first <= 12 and 1 <= second <= 31:
            return "us"
        if 1 <= first <= 31 and 1 <= second <= 12:
            return "eu"
    return None


def _leading_int(text: str) -> int:
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else 0


def leading_int(c: Column) -> Column:
    """The number that a text starts with, or 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def date_format(c: Column) -> Column:
    """``detect_date_format`` as a column; null where no format is recognised."""
    n, third = F.length(c), F.substring(c, 3, 1)
    first, second = leading_int(c), leading_int(c.substr(F.lit(4), F.lit(100)))
    short = (n >= 8) & third.isin("/", ".")
    kind = F.when((n >= 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-"), "iso")
    for least, name in ((16, "chromium"), (13, "unix_ms"), (9, "unix")):
        kind = kind.when(c.rlike(r"\A[0-9]+\z") & (n >= least), name)
    kind = kind.when(short & (third == "/") & first.between(1, 12) & second.between(1, 31), "us")
    return kind.when(short & first.between(1, 31) & second.between(1, 12), "eu")


def import_date(c: Column, kind: str | None) -> Column:
    """ISO text of an imported date; text that does not parse stays as it is."""
    if kind is None:
        return c
    if kind == "iso":
        t = F.when((F.locate(" ", c) == 11), F.concat(F.substring(c, 1, 10), F.lit("T"), c.substr(F.lit(12), F.lit(100)))).otherwise(c)
        zoned = t.endswith("Z") | t.endswith("+") | t.substr(F.lit(20), F.lit(100)).rlike("[+-]")
        return F.when((F.length(t) >= 19) & ~zoned, F.concat(t, F.lit("Z"))).otherwise(t)
    if kind in ("unix", "unix_ms", "chromium"):
        number = F.coalesce(F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("long"), F.lit(0))
        if kind == "chromium":
            seconds = _div(number, 1_000_000) - CHROMIUM_SHIFT
        else:
            seconds = unix_seconds(number, kind)
        return iso_text(seconds)
    clock = r"(?:\s+(\d+):(\d+)(?::(\d+))?\s*([A-Za-z]*))?"
    pattern = rf"^\s*(\d+)[/]\s*(\d+)[/]\s*(\d+){clock}" if kind == "us" else rf"^\s*(\d+)[/.]\s*(\d+)[/.]\s*(\d+){clock}"
    part = lambda k: F.coalesce(F.regexp_extract(c, pattern, k).try_cast("int"), F.lit(0))
    month, day = (part(1), part(2)) if kind == "us" else (part(2), part(1))
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    hour = part(4)
    if kind == "us":
        half = F.lower(F.substring(F.regexp_extract(c, pattern, 7), 1, 1))
        hour = F.when((half == "p") & (hour != 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)
    made = F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", year, month, day, hour, part(5), part(6))
    return F.when(c.rlike(pattern), made).otherwise(c)


def bookmark_iso(text: str | None) -> str:
    """ISO text of a bookmark's time: Chromium from 16 digits on, else Unix seconds; '' out of range; other text stays."""
    from datetime import UTC, datetime

    if not text:
        return ""
    if not (text.isascii() and text.isdigit()):
        return text
    seconds = int(text[:20])
    if len(text) >= 16:
        seconds = seconds // 1_000_000 - CHROMIUM_SHIFT
    if not 0 <= seconds <= 4_102_444_800:
        return ""
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_iso(c: Column) -> Column:
    """Timestamp of ISO text, null where it does not parse."""
    return F.try_to_timestamp(F.when(c == NEVER, None).otherwise(c))
