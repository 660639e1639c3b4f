"""Line deduplication across documents.

Lines are exploded to one row per document and normalised line, with a 128-bit hash of the
line and its positions in the document. Documents are counted per hash; lines over the
threshold are dropped wherever they stand, except in the document with the largest id, and
what is left of a document is put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, materialize, release, resting_on, text_of

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased (UTF-8 in and out)."""
    return line.strip().lower()


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """From (id, mark, text): one row per document and line key of at least ``min_chars`` code points."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            hashes: list[bytes] = []
            places: list[list[int]] = []
            for i, text in enumerate(batch.column(2)):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                owner += [i] * len(found)
                hashes += found
                places += found.values()
            halves = np.frombuffer(b"".join(hashes), dtype=">i8").astype("<i8").reshape(-1, 2)
            rows = pa.array(owner, pa.int32())
            arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "h1", "h2", "places"])

    return map_batches(docs, run, f"id {kind}, mark long, h1 long, h2 long, places array<int>")


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """From (id, mark, text), stored: id, mark and the positions of the lines that go, where there are any."""
    lines = materialize(line_rows(docs, min_chars), "lines")
    # Rows of a hash are at least as many as its documents, so this loses no line.
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select("h1", "h2")
    often = materialize(often, "lines-often")
    found = materialize(lines.join(broadcast_if_small(often), ["h1", "h2"]), "lines-found")
    holders = found.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
    holders = holders.agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    holders = materialize(holders.select("h1", "h2", "keeper"), "lines-holders")
    gone = found.join(broadcast_if_small(holders), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # One row per document and line key, so what a group gathers is bounded by its document.
    gone = gone.groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))
    gone = materialize(gone, "lines-gone")
    release(lines, often, found, holders)
    return gone


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    into: str = "kept_text",
    prefix: str = "",
) -> DataFrame:
    """``docs`` with the kept text, and the number of lines before and dropped.

    A line goes when its key (ASCII white space stripped, A-Z lower-cased) has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` documents, unless its
    document has the largest id of those. Documents are told apart by id, so rows with the
    same id count once (rows without an id count as one document, never the largest unless
    alone). Null text counts as empty: one empty line. New columns are ``into``,
    ``n_lines`` and ``n_dropped`` (with ``prefix``); they must not exist. An empty table
    gives none.
    """
    lines_col, dropped_col = f"{prefix}n_lines", f"{prefix}n_dropped"
    if clash := {into, lines_col, dropped_col} & set(docs.columns):
        raise ValueError(f"the documents have columns {sorted(clash)} already")
    # mark tells rows with the same id but other texts apart.
    mark = F.xxhash64(text_of(text_col))
    stored = dropped_places(docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).alias("text")), min_chars, min_docs)
    gone = broadcast_if_small(stored).select(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark"), F.col("gone").alias("_gone"))
    on = F.col(id_col).eqNullSafe(F.col("_gone_id")) & (mark == F.col("_gone_mark"))
    joined = docs.join(gone, on, "left")
    lines = F.split(text_of(text_col), "\n", -1)
    # The text is split once for all its lines: a lambda's argument is evaluated before its body.
    staying = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone"))
    joined_again = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(staying(ls), lambda i: F.get(ls, i)), "\n"))
    out = joined.select(
        *docs.columns,
        F.when(F.col("_gone").isNull(), text_of(text_col)).otherwise(F.get(joined_again, F.lit(0))).alias(into),
        F.size(lines).cast("long").alias(lines_col),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(dropped_col),
    )
    return resting_on(out, stored)
