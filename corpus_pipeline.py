"""A pipeline that turns raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the docs of the next. All stages
but the last return the columns of the table documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histlab.llm.common import broadcast_if_small, documents, materialize, release_under, table
from histlab.llm.line_dedup import line_dedup
from histlab.llm.packing import pack
from histlab.llm.pii import redact
from histlab.llm.quality import quality
from histlab.llm.queries import tokenizer_file
from histlab.llm.shingle_join import jaccard_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _without(docs: DataFrame, decided: DataFrame, stays: Column) -> DataFrame:
    """The documents but for those ids none of whose decided rows stays.

    Fewer documents go than stay, so it is their ids that are stored, and broadcast where the
    stored table has been measured and is small; the texts are then not shuffled.
    """
    gone = decided.groupBy(F.col("doc_id").alias("_id")).agg(stays.alias("stays")).where("not stays").select("_id")
    gone = materialize(gone, "gone")
    release_under(decided)
    return docs.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a doc_id goes only if all its rows are rejected."""
    judged = quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged, F.bool_or("accepted"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many of them share."""
    return _measured(line_dedup(docs, into="_kept", prefix="_").withColumn("text", F.col("_kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    joined = jaccard_join(docs)
    return _without(docs, joined, F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its type."""
    return _measured(redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with the ids of each piece."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the segment model and the tokenizer can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
