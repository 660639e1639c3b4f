"""Bookmark HTML: one file becomes many rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import decode_entities
from ..functions.times import bookmark_iso, parse_iso
from ..schema import conform

MAX_DEPTH = 32
SNIFF = 4096
_SPACES = " \t\n\v\f\r"


def attribute(tag: str, name: str) -> str:
    """The value of an attribute within a tag's text, in any case, quoted or not; '' where it is missing."""
    for m in re.finditer(rf"(?i)(?:(?<=[ \t\n\v\f\r])|\A){name}[ \t\n\v\f\r]*=[ \t\n\v\f\r]*", tag):
        rest = tag[m.end() :]
        if rest[:1] in ('"', "'") and rest:
            return rest[1:].split(rest[0], 1)[0]
        return re.match(r"[^ \t\n\v\f\r>]*", rest)[0]
    return ""


def _tag_end(text: str, at: int) -> int:
    """Where the tag that begins before ``at`` is closed; signs within quotes don't close it."""
    quote = ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i
    return -1


def parse(text: str, folders: bool = True, max_depth: int = MAX_DEPTH, legacy: bool = False) -> Iterator[tuple[str, str, str, str, str]]:
    """(url, title, folder, ISO time, icon) of each link; nothing where the text is no bookmark file.

    A link's folder is the last heading of the list that it stands in. ``legacy`` keeps the
    name of a nested folder for the links behind it.
    """
    text = text.removeprefix("﻿")
    if not re.search(r"<[Dd][TtLl]", text[:SNIFF]):
        return
    stack: list[str] = []
    current = ""
    at = 0
    while (start := text.find("<", at)) >= 0:
        if text.startswith("!--", start + 1):
            end = text.find("-->", start)
            if end < 0:
                return
            at = end + 3
            continue
        end = _tag_end(text, start + 1)
        if end < 0:
            return
        tag, at = text[start + 1 : end], end + 1
        name = re.match(r"/?[A-Za-z0-9]*", tag)[0].upper()
        inner = text[at : text.find("<", at) if text.find("<", at) >= 0 else len(text)].strip(_SPACES)
        if name == "DL":
            if len(stack) < max_depth:
                stack.append(current)
        elif name == "/DL":
            if stack:
                own = stack.pop()
                current = (stack[-1] if stack else "") if not legacy else (own if stack else "")
        elif name in ("H1", "H3"):
            current = decode_entities(inner)
            if legacy and stack:
                stack[-1] = current
        elif name == "A":
            url = decode_entities(attribute(tag, "HREF"))
            if url:
                title = decode_entities(inner)
                folder = current if folders else ""
                when = attribute(tag, "LAST_VISIT") or attribute(tag, "ADD_DATE")
                icon = attribute(tag, "ICON_URI") or attribute(tag, "ICON")
                yield url, f"[{folder}] {title}" if folder and title else title, folder, bookmark_iso(when), icon


@udtf(returnType="url string, title string, folder string, last_visit_time string, icon string")
class BookmarkRows:
    def eval(self, content: str):
        yield from parse(content or "")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """Bookmark files in the history schema, with folder and icon behind."""
    files = spark.read.text(path, wholetext=True)
    rows = files.lateralJoin(BookmarkRows(F.col("value").outer())).drop("value")
    rows = rows.withColumns({"pos": F.monotonically_increasing_id(), "visit_count": F.lit(1), "typed_count": F.lit(0), "last_visit": parse_iso(F.col("last_visit_time")), "source": F.lit("bookmarks")})
    return conform(rows, "folder", "icon")
