"""The binary event log: bytes to tab events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.tabs import EVENTS

#: The clock before the first event, and the largest step, in microseconds (fixed values).
START_US = 10**15
HOUR_US = 3600 * 10**6


def decode(data: bytes) -> Iterator[tuple[int, str, int, str, str, int]]:
    """(number, type, tab id, url, title, microseconds) of each event.

    An event is a type, a tab id, a step of the clock (64 bits, little-endian), and URL and
    title, each behind its length. What is cut off at the end of a URL or title is left out.
    """
    at, clock, number = 0, START_US, 0
    while at + 11 < len(data):
        kind, tab = EVENTS[data[at] % len(EVENTS)], data[at + 1] + 1
        step = int.from_bytes(data[at + 2 : at + 10], "little", signed=True)
        clock += abs(step) % HOUR_US + 1_000_000
        at += 10
        texts = []
        for _ in range(2):
            size = data[at] if at < len(data) else 0
            texts.append(data[at + 1 : at + 1 + size].decode("utf-8", "replace"))
            at += 1 + min(size, max(0, len(data) - at - 1))
        yield number, kind, tab, texts[0], texts[1], clock
        number += 1


@udtf(returnType="event_id long, type string, tab_id int, url string, title string, us long")
class EventRows:
    def eval(self, content: bytes):
        yield from decode(bytes(content or b""))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Tab events of binary logs, one user per file."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("user_id"), "content")
    rows = files.lateralJoin(EventRows(F.col("content").outer()))
    return rows.select("user_id", "event_id", "type", "tab_id", "url", "title", F.timestamp_micros("us").alias("ts"))
