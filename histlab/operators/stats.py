"""Global statistics, histograms and the browsing analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority_text, parsed

DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def history_stats(history: DataFrame) -> DataFrame:
    """One row: counts, sums, first and last visit, the most visited page (first of equals), distinct authorities."""
    order = F.struct(F.col("visit_count"), -F.col("pos"))
    top = F.when(F.max("visit_count") > 0, F.max_by(F.struct("url", "title"), order))
    return history.agg(
        F.count("*").alias("total_urls"),
        F.coalesce(F.sum("visit_count"), F.lit(0)).cast("long").alias("total_visits"),
        F.min("last_visit").alias("earliest"),
        F.max("last_visit").alias("latest"),
        top["url"].alias("top_url"),
        top["title"].alias("top_title"),
        F.greatest(F.max("visit_count"), F.lit(0)).cast("long").alias("top_visits"),
        F.countDistinct(authority_text(F.col("url"))).alias("unique_authorities"),
    )


def unique_hosts(history: DataFrame) -> DataFrame:
    """One row: distinct hosts, in lower case, without port and userinfo."""
    history = history.withColumn("_p", parsed(F.col("url"))).withColumn("_host", F.lower("_p.host"))
    host = F.col("_host")
    return history.agg(F.countDistinct(F.when(host != "", host)).alias("unique_hosts"))


def _dense(history: DataFrame, n: int, name: str, value: Column) -> DataFrame:
    """Visits by a number from 0 to n - 1, with zeros."""
    counted = history.where(value.isNotNull()).groupBy(value.cast("int").alias(name)).agg(F.sum("visit_count").alias("v"))
    every = history.sparkSession.range(n).select(F.col("id").cast("int").alias(name))
    return every.join(F.broadcast(counted), name, "left").select(name, F.coalesce("v", F.lit(0)).cast("long").alias("visits"))


def hourly_visits(history: DataFrame) -> DataFrame:
    return _dense(history, 24, "hour", F.hour("last_visit"))


def weekday_visits(history: DataFrame) -> DataFrame:
    """0 is Sunday."""
    return _dense(history, 7, "weekday", F.dayofweek("last_visit") - 1)


def peaks(history: DataFrame) -> DataFrame:
    """Busiest and quietest hour and busiest day, the first of equals; 0 where nothing was visited."""
    h = hourly_visits(history).agg(
        F.max_by("hour", F.struct("visits", -F.col("hour"))).alias("peak_hour"), F.min_by("hour", F.struct("visits", "hour")).alias("quiet_hour")
    )
    d = weekday_visits(history).agg(F.max_by("weekday", F.struct("visits", -F.col("weekday"))).alias("peak_day"))
    return h.crossJoin(d)


def bars(histogram: DataFrame, value: str = "visits") -> DataFrame:
    """``histogram`` with the bar of each row, in percent of the longest."""
    most = histogram.agg(F.max(value).alias("_most"))  # one row
    return histogram.crossJoin(F.broadcast(most)).withColumn("bar", F.expr(f"{value} * 100 div greatest(_most, 1)")).drop("_most")


def analysis(classified: DataFrame, history: DataFrame) -> DataFrame:
    """One row of scores and insights; ``classified`` has category and visit_count per row of history."""
    visits = lambda *names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("visit_count"))), F.lit(0)).cast("long")
    per_category = classified.groupBy("category", "category_idx").agg(F.sum("visit_count").alias("v"), F.count("*").alias("n"))
    one = classified.agg(
        F.count("*").alias("entries"),
        visits("Development", "Productivity", "Education", "AI Tools").alias("productive"),
        visits("Social Media", "Entertainment").alias("distracting"),
        F.count(F.when(F.col("category") == "AI Tools", 1)).alias("ai_entries"),
        visits("AI Tools").alias("ai_visits"),
    )
    top = per_category.where("v > 0").agg(F.max_by(F.struct("category", "v"), F.struct("v", -F.col("category_idx"))).alias("top"))
    row = one.crossJoin(top).crossJoin(peaks(history))
    row = row.withColumn("dominant_category", F.coalesce("top.category", F.lit("Other")))
    row = row.withColumn("dominant_visits", F.coalesce("top.v", F.lit(0)).cast("long")).drop("top")
    row = row.withColumn("dominant_percent", F.expr("dominant_visits * 100 div (entries + 1)"))
    row = row.withColumn("productivity_score", F.expr("100 * productive div (productive + distracting + 1)"))
    verdict = F.when(F.col("productivity_score") >= 70, "Highly focused browsing pattern.").when(F.col("productivity_score") >= 40, "Balanced between work and leisure.").otherwise("Leisure-heavy browsing detected.")
    days = F.array(*map(F.lit, DAYS))
    # The wording of the insights, here and in the verdict above.
    return row.select(
        "entries", "productive", "distracting", "productivity_score", "dominant_category", "dominant_visits", "dominant_percent", "peak_hour", "quiet_hour", "peak_day",
        F.format_string("Your browsing is dominated by %s (%d%% of tracked visits).", "dominant_category", "dominant_percent").alias("insight_primary"),
        F.format_string("Peak activity at %d:00 on %ss. Quietest hour: %d:00.", "peak_hour", F.get(days, F.col("peak_day")), "quiet_hour").alias("insight_focus"),
        F.concat(F.format_string("Productivity score: %d/100 — ", "productivity_score"), verdict).alias("insight_habit"),
        F.when(F.col("ai_entries") > 0, F.format_string("AI tool usage detected (%d visits). You're leveraging AI effectively.", "ai_visits"))
        .otherwise("Consider using AI tools like ChatGPT or Claude to boost productivity.")
        .alias("insight_recommendation"),
    )
