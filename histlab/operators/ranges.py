"""Work in one order over all rows, without bringing them into one task.

Rows are sorted into ranges, one per partition, and stored with the number of their range and
their place in it. What goes from one range to the next is one row per range, which is
bounded by the number of partitions and therefore summed in one place and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import shared_folder

RANGE, PLACE = "_range", "_place"


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df``, stored, with its range and its place within it from 0, in ``order`` over all rows."""
    spark = df.sparkSession
    path = shared_folder(spark, "ranges")
    # The number of a sorted row is that of its partition and its place there.
    at = F.monotonically_increasing_id()
    df.orderBy(*order).withColumn(PLACE, at).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.withColumns({RANGE: F.shiftright(PLACE, 33), PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))})


def carried(ranged: DataFrame, value: Column, combine, name: str) -> DataFrame:
    """``ranged`` with ``combine`` of the aggregate ``value`` over all ranges before the own one."""
    per_range = ranged.groupBy(RANGE).agg(value.alias(name))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select(RANGE, combine(name).over(before).alias(name))
    return ranged.join(F.broadcast(per_range), RANGE)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1."""
    out = carried(in_ranges(df, order), F.count("*"), F.sum, "_rows")
    return out.withColumn(name, F.coalesce("_rows", F.lit(0)) + F.col(PLACE) + 1).drop("_rows", RANGE, PLACE)
