"""The history schema, and the derived history of the synthetic tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = (
    "pos bigint, url string, title string, visit_count bigint, typed_count bigint, last_visit_time string, "
    "last_visit timestamp, last_visit_raw bigint, ts_format string, source string, browser string, profile string, incognito boolean"
)
TAB_EVENTS = "user_id bigint, event_id bigint, type string, tab_id int, url string, title string, ts timestamp"

#: Which tab event an event of the synthetic stream stands for.
EVENT_KINDS = {"view": "NAVIGATE", "click": "OPEN", "signup": "SWITCH", "purchase": "RELOAD", "error": "CLOSE"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new place in the folder that all executors share (spark.checkpoint.dir), deleted at exit.

    Where the setting is absent, as in tests, a local session has a temporary folder; a cluster
    has none that all executors share, so it must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="histlab-")
    path = f"{base.rstrip('/')}/histlab-{label}-{uuid.uuid4().hex}"
    _places.append((spark, path))
    return path


_places: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_places() -> None:
    for spark, path in _places:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            return


def conform(df: DataFrame, *extra: str) -> DataFrame:
    """``df`` in the history schema; columns that it lacks are null. ``extra`` columns stay behind."""
    have = set(df.columns)
    fields = (f.split() for f in HISTORY.split(", "))
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields), *extra)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the synthetic stream with the page that each falls on."""
    pages, events = read(spark, sf_dir, "pages"), read(spark, sf_dir, "events")
    n = pages.agg(F.count("*").alias("n"))
    numbered = events.crossJoin(n).withColumn("page_id", F.col("event_id") % F.col("n")).drop("n")
    return numbered.join(pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")), "page_id")


def history(spark: SparkSession, sf_dir: str, weighted: bool = True) -> DataFrame:
    """pos, url, title, visit_count, typed_count, last_visit from pages and events.

    Visits are aggregated by page number before the pages' texts are joined, so the shuffle
    carries numbers only. ``weighted`` replaces the even visit counts by ones from 1 to 120.
    """
    pages, events = read(spark, sf_dir, "pages"), read(spark, sf_dir, "events")
    n = pages.agg(F.count("*").alias("n"))
    by_page = events.crossJoin(n).groupBy((F.col("event_id") % F.col("n")).alias("page_id"))
    counts = by_page.agg(
        F.count("*").alias("visit_count"),
        F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).cast("long").alias("typed_count"),
        F.max("ts").alias("last_visit"),
    )
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    out = pages.select("page_id", "url", title.alias("title")).join(counts, "page_id")
    visit_count = (F.lit(1) + (F.col("page_id") * 37) % 120).cast("long") if weighted else F.col("visit_count")
    return out.select(F.col("page_id").alias("pos"), "url", "title", visit_count.alias("visit_count"), "typed_count", "last_visit")
