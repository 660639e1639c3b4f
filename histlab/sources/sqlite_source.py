"""Browser databases as a Python data source, with the time filter pushed into the database."""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from ..functions.times import iso_text, unix_seconds
from ..schema import conform

FORMAT = "histlab_sqlite"

#: Tables of the databases and the columns that are read from them.
TABLES = {
    "urls": ("id bigint, url string, title string, visit_count bigint, typed_count bigint, last_visit_time bigint", "last_visit_time"),
    "moz_places": ("id bigint, url string, title string, visit_count bigint, typed bigint", None),
    "moz_historyvisits": ("place_id bigint, visit_date bigint", "visit_date"),
}


@dataclass
class FilePart(InputPartition):
    path: str


class SqliteReader(DataSourceReader):
    """One partition per database. Databases are copied first, since a running browser locks them."""

    def __init__(self, options: dict):
        self.table = options["table"]
        self.paths = options["path"].split("\n")
        self.columns = options["columns"].split(",") if "columns" in options else [f.split()[0] for f in TABLES[self.table][0].split(", ")]
        self.where: list[tuple[str, int]] = []

    def pushFilters(self, filters):
        time = TABLES[self.table][1]
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == (time,):
                self.where.append((f'"{time}" {">=" if isinstance(f, GreaterThanOrEqual) else ">"} ?', f.value))
            else:
                yield f

    def partitions(self):
        return [FilePart(p) for p in self.paths]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory() as folder:
            copy = Path(folder, "copy.db")
            # What a running browser has not yet moved into the database lies in its log.
            for log in ("", "-wal"):
                if Path(partition.path + log).exists() or not log:
                    shutil.copyfile(partition.path + log, f"{copy}{log}")
            db = sqlite3.connect(copy)
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            try:
                select = ", ".join(f'"{c}"' for c in self.columns)
                where = f" where {' and '.join(w for w, _ in self.where)}" if self.where else ""
                for row in db.execute(f'select {select} from "{self.table}"{where}', [v for _, v in self.where]):
                    yield (partition.path, *row)
            finally:
                db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        fields = dict(f.split() for f in TABLES[self.options["table"]][0].split(", "))
        wanted = self.options.get("columns", "").split(",") if "columns" in self.options else list(fields)
        return ", ".join(["file string", *(f"{c} {fields[c]}" for c in wanted)])

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def _scan(spark: SparkSession, paths: list[str], table: str, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(table=table, path="\n".join(paths), **options).load()


def _shaped(rows: DataFrame, kind: str) -> DataFrame:
    seconds = unix_seconds(F.col("last_visit_raw"), kind)
    seen = F.when(F.coalesce("last_visit_raw", F.lit(0)) != 0, seconds)
    rows = rows.withColumns({"title": F.coalesce("title", F.lit("")), "last_visit": F.timestamp_seconds(seen), "last_visit_time": F.coalesce(iso_text(seen), F.lit("")), "ts_format": F.lit(kind)})
    return conform(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("source", F.lit("sqlite")))


def read_chromium(spark: SparkSession, paths: list[str], cutoff: int | None = None, inclusive: bool = False) -> DataFrame:
    """Rows of ``urls``; with a cutoff (raw time) only later ones, and those at it if ``inclusive``."""
    rows = _scan(spark, paths, "urls", columns="url,title,visit_count,typed_count,last_visit_time")
    if cutoff is not None:
        time = F.col("last_visit_time")
        rows = rows.where(time >= cutoff if inclusive else time > cutoff)
    return _shaped(rows.withColumnRenamed("last_visit_time", "last_visit_raw"), "chromium")


def read_firefox(spark: SparkSession, paths: list[str], cutoff: int | None = None) -> DataFrame:
    """Places with their last visit; a cutoff (raw time, inclusive) drops visits before they are grouped."""
    seen = _scan(spark, paths, "moz_historyvisits")
    if cutoff is not None:
        seen = seen.where(F.col("visit_date") >= cutoff)
    last = seen.groupBy("file", "place_id").agg(F.max("visit_date").alias("last_visit_raw"))
    places = _scan(spark, paths, "moz_places").withColumnsRenamed({"id": "place_id", "typed": "typed_count"})
    return _shaped(places.join(last, ["file", "place_id"]), "firefox")
