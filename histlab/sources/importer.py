"""Imports by the ending of a file's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import conform
from .bookmarks import read_bookmarks
from .csv_files import read_csv
from .extension_json import read_json


def auto_import(spark: SparkSession, path: str) -> DataFrame:
    """.html and .htm as bookmarks, .csv and .tsv as tables, all else as JSON, or as bookmarks if that gives nothing."""
    low = path.lower()
    if low.endswith((".html", ".htm")):
        return conform(read_bookmarks(spark, path))
    if low.endswith((".csv", ".tsv")):
        return read_csv(spark, path)
    rows = read_json(spark, path)
    return conform(read_bookmarks(spark, path)) if rows.isEmpty() else rows
