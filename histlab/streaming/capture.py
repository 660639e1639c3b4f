"""Live capture of page visits: filters, counters, durable log, retention.

Batches, retries and the buffer of the capture are the stream's trigger, checkpoint and sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sets import last_n

EVENT = "url string, title string, ts timestamp, incognito boolean, status string, tab_id int, window_id int"
#: Addresses that are not recorded (fixed values).
PRIVATE_PREFIXES = ("chrome://", "chrome-extension://", "brave://", "about:")
FLUSH_SECONDS = 30
RETAINED, LOG_RETAINED = 50_000, 1000


def captured(events: DataFrame) -> DataFrame:
    """Completed loads with an address that is not the browser's own."""
    own = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        own = own | F.col("url").startswith(prefix)
    return events.where((F.col("status") == "complete") & (F.coalesce("url", F.lit("")) != "") & ~own)


def requests(events: DataFrame) -> DataFrame:
    """Web requests only."""
    return events.where(F.col("url").startswith("http"))


def counters(events: DataFrame) -> DataFrame:
    """Running totals by kind of window; a stateful count when ``events`` is a stream."""
    return events.groupBy("incognito").count()


def totals(events: DataFrame) -> DataFrame:
    """One row: visits in all, in private windows and in normal ones."""
    return events.agg(F.count("*").alias("total"), F.count_if("incognito").alias("incognito"), F.count_if(~F.col("incognito")).alias("normal"))


def write_log(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append to a durable log; a batch that fails is written again from the checkpoint."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")
    return writer.start()


def compacted(spark: SparkSession, path: str, keep: int = RETAINED) -> DataFrame:
    """The newest rows of a log, to be written as its next generation."""
    return last_n(spark.read.parquet(path), keep, "ts", "url")


def with_stream_metadata(visits: DataFrame, metadata: DataFrame, delay: str = "1 minute", within: str = "30 seconds") -> DataFrame:
    """Stream-stream left join of visits (tab_id, ts, url) with metadata (tab_id, ts, description, keywords) that follows within a time."""
    v = visits.withWatermark("ts", delay).alias("v")
    m = metadata.withColumnsRenamed({"ts": "m_ts", "tab_id": "m_tab"}).withWatermark("m_ts", delay).alias("m")
    on = (F.col("v.tab_id") == F.col("m.m_tab")) & (F.col("m.m_ts") >= F.col("v.ts")) & (F.col("m.m_ts") <= F.col("v.ts") + F.expr(f"interval {within}"))
    return v.join(m, on, "left")


def recent(spark: SparkSession, path: str, keep: int = LOG_RETAINED) -> DataFrame:
    """The newest requests of a log."""
    return compacted(spark, path, keep)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """One row over a log: totals by kind of window, first and last time."""
    log = spark.read.parquet(path)
    return log.agg(
        F.count("*").alias("total"), F.count_if("incognito").alias("incognito"), F.count_if(~F.col("incognito")).alias("normal"), F.min("ts").alias("started"), F.max("ts").alias("updated")
    )


def reset(spark: SparkSession, *paths: str) -> None:
    """Delete a log and its checkpoint."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
