"""JSON exports of the browser extension and of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_iso
from ..schema import conform

EXTENSION = "incognito-history-tracker-extension"
ROW = "url string, title string, timestamp string, incognito boolean, visit_count bigint, typed_count bigint, last_visit_time string"
SCHEMA = f"success boolean, timestamp string, error string, source string, version string, data array<struct<{', '.join(f.replace(' ', ':', 1) for f in ROW.split(', '))}>>"


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of ``data`` in the history schema. Rows without an address are dropped.

    Files of the extension record visits one by one, so each row counts as one; other files
    keep their counts. With ``lines`` each line is an export of its own. Titles of private visits get a mark. A file that is no such export
    gives no rows.
    """
    files = spark.read.schema(SCHEMA).json(path, multiLine=not lines)
    rows = files.select("source", F.explode("data").alias("e")).select(F.col("source").alias("_from"), "e.*").where(F.coalesce("url", F.lit("")) != "")
    one = F.coalesce(F.col("_from") == EXTENSION, F.lit(False))
    when = F.coalesce(F.when(one, F.col("timestamp")), "last_visit_time", "timestamp", F.lit(""))
    private = F.coalesce("incognito", F.lit(False))
    title = F.coalesce("title", F.lit(""))
    rows = rows.withColumns(
        {
            "pos": F.monotonically_increasing_id(),
            "title": F.when(private, F.concat(F.lit("[INCOGNITO] "), title)).otherwise(title),
            "visit_count": F.when(one, F.lit(1)).otherwise(F.coalesce("visit_count", F.lit(1))),
            "typed_count": F.when(one, F.lit(0)).otherwise(F.coalesce("typed_count", F.lit(0))),
            "last_visit_time": when,
            "last_visit": parse_iso(when),
            "source": F.lit("json"),
            "incognito": private,
        }
    )
    return conform(rows)
