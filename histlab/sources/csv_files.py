"""CSV and TSV imports: what the file looks like is found on the driver from its start, the rest is read by Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import date_format, import_date, leading_int, parse_iso
from ..schema import conform

SNIFF_BYTES, SNIFF_LINES = 8192, 16
DELIMITERS = ",\t;|"

#: Names of columns that are recognised, whatever their case.
NAMES = {
    "url": "url uri address link page_url page",
    "title": "title name page_title description",
    "visit_count": "visit_count visits count hit_count frequency",
    "last_visit_time": "last_visit_time last_visit_date last_visited date timestamp time last_visit visited visit_date",
    "typed_count": "typed_count typed",
}
#: The order of columns in a file without a header.
POSITIONS = ("url", "title", "visit_count", "last_visit_time")


def detect_delimiter(text: str) -> str:
    """The delimiter with the highest product of its count in the first line that has it and the
    number of lines with that count; quoted text doesn't count, and the first of equals wins."""
    lines: list[str] = []
    line, quoted = "", False
    for c in text[:SNIFF_BYTES]:
        if c == '"':
            quoted = not quoted
        if c == "\n" and not quoted:
            lines.append(line)
            line = ""
            if len(lines) == SNIFF_LINES:
                break
        elif not quoted:
            line += c
    else:
        lines.append(line)
    best, most = ",", 0
    for d in DELIMITERS:
        counts = [n for n in (x.count(d) for x in lines) if n]
        value = counts[0] * sum(n == counts[0] for n in counts) if counts else 0
        if value > most:
            best, most = d, value
    return best


def is_address(url: Column) -> Column:
    """Whether a value can be an address at all."""
    out = url.contains("://")
    for prefix in ("about:", "file:", "data:"):
        out = out | url.startswith(prefix)
    return out & (url != "")


@dataclass
class Layout:
    delimiter: str
    header: bool
    columns: dict[str, int] = field(default_factory=dict)
    date_format: str | None = None


def _first_rows(text: str, delimiter: str, n: int) -> list[list[str]]:
    import csv
    from io import StringIO

    out = []
    for row in csv.reader(StringIO(text), delimiter=delimiter):
        if row:
            out.append([x.rstrip() for x in row])
        if len(out) == n:
            break
    return out


def sniff(text: str, delimiter: str | None = None) -> Layout:
    """The layout of a file from its start: delimiter, header and columns."""
    text = text.removeprefix("﻿")
    delimiter = delimiter or detect_delimiter(text)
    rows = _first_rows(text, delimiter, 200)
    if not rows:
        return Layout(delimiter, False)
    columns: dict[str, int] = {}
    for i, name in enumerate(rows[0]):
        for column, known in NAMES.items():
            if name.strip().lower() in known.split() and column not in columns:
                columns[column] = i
    header = bool(columns)
    if not header:
        columns = {c: i for i, c in enumerate(POSITIONS) if i < len(rows[0])}
    return Layout(delimiter, header, columns)


def read_csv(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """One file (or a folder of files with one layout) in the history schema.

    Rows without an address are dropped; counts below 1 become 1; text that is not UTF-8 is
    taken as Latin-1. Dates have the format of the first one, among all rows with an address,
    whose format is recognised; what stands before it stays as it is. The rest of the layout
    is found from the first SNIFF_BYTES, which are all that reaches the driver.
    """
    layout = layout or sniff(head(spark, path))
    width = max([8, *(i + 1 for i in layout.columns.values())])
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "multiLine": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE", "header": layout.header, "enforceSchema": True, "encoding": encoding_of(spark, path)}
    # The position is counted before any condition, as it moves on only where it is evaluated.
    raw = spark.read.options(**options).schema(schema).csv(path).withColumn("pos", F.monotonically_increasing_id())
    value = lambda c: F.coalesce(F.col(f"c{layout.columns[c]}"), F.lit("")) if c in layout.columns else F.lit("")
    url = F.ltrim(F.regexp_replace(value("url"), "^﻿", ""))
    when = value("last_visit_time")
    kind, since = layout.date_format, 0
    if kind is None and "last_visit_time" in layout.columns:
        dates = raw.select("pos", url.alias("url"), date_format(when).alias("kind"))
        dates = dates.where(is_address(F.col("url")) & F.col("kind").isNotNull())
        kind, since = dates.agg(F.min_by("kind", "pos"), F.min("pos")).first()
    iso = F.when(F.col("pos") >= F.lit(since or 0), import_date(when, kind)).otherwise(when)
    rows = raw.select(
        "pos",
        url.alias("url"),
        value("title").alias("title"),
        F.greatest(leading_int(value("visit_count")), F.lit(1)).alias("visit_count"),
        leading_int(value("typed_count")).alias("typed_count"),
        F.when(when != "", iso).otherwise("").alias("last_visit_time"),
    )
    rows = rows.where(is_address(F.col("url")))
    return conform(rows.withColumns({"last_visit": parse_iso(F.col("last_visit_time")), "source": F.lit("csv")}))


def head(spark: SparkSession, path: str) -> str:
    """The first lines of the input, at most SNIFF_BYTES; only these reach the driver."""
    rows = spark.read.text(path).select(F.substring(F.col("value").cast("binary"), 1, SNIFF_BYTES).alias("line")).limit(4 * SNIFF_LINES).collect()
    data = b"\n".join(bytes(r["line"]) for r in rows)[:SNIFF_BYTES] + b"\n"
    try:
        return data.decode("utf-8", "strict" if len(data) <= SNIFF_BYTES else "ignore")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines are valid UTF-8, else ISO-8859-1; lines are tested where they lie."""
    bad = spark.read.text(path).where(~F.is_valid_utf8(F.col("value")))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"
