"""Browser databases as files, one per partition, for other tools and for the queries over imports."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Columns that a row needs for each kind, and how it is stored.
KINDS = {
    "chromium": (
        ("url", "title", "visit_count", "typed_count", "last_visit_time"),
        ("create table urls (id integer primary key, url text, title text, visit_count integer, typed_count integer, last_visit_time integer)",),
        (("insert into urls (url, title, visit_count, typed_count, last_visit_time) values (?, ?, ?, ?, ?)", (0, 1, 2, 3, 4)),),
    ),
    "firefox": (
        ("place_id", "url", "title", "visit_count", "typed", "visit_date"),
        ("create table moz_places (id integer primary key, url text, title text, visit_count integer, typed integer)", "create table moz_historyvisits (place_id integer, visit_date integer)"),
        (("insert or ignore into moz_places values (?, ?, ?, ?, ?)", (0, 1, 2, 3, 4)), ("insert into moz_historyvisits values (?, ?)", (0, 5))),
    ),
}


def write_databases(rows: DataFrame, folder: str, kind: str) -> list[str]:
    """Write each partition of ``rows`` as one database in a folder that all executors mount; gives their paths.

    Rows of a Firefox place must lie in one partition. A task that is run again replaces its file.
    """
    columns, tables, inserts = KINDS[kind]
    place = folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        os.makedirs(place, exist_ok=True)
        path = f"{place}/{context.partitionId()}.db"
        unfinished = f"{path}.{context.taskAttemptId()}"
        db = sqlite3.connect(unfinished)
        with db:
            for table in tables:
                db.execute(table)
            for batch in batches:
                values = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for insert, at in inserts:
                    db.executemany(insert, ([v[k] for k in at] for v in values))
        db.close()
        os.replace(unfinished, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return sorted(r["path"] for r in rows.select(*columns).mapInArrow(run, "path string").collect())  # one row per partition
