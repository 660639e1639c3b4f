"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("terms")


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(documents(spark, sf_dir))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    from .toxicity import fold

    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out=fold("doc_id") == 0)


def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii

    found = find_pii(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
    )


def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op6_grouped_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import jaccard_join

    return jaccard_join(documents(spark, sf_dir), width=3, percent=90, links=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_rules

    out = quality_rules(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_share", "longest_repeat_bytes"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import decode_ids, encode_texts

    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_texts(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern)
    # The text is not needed any more; only ids and what they decode to are sent on.
    decoded = decode_ids(encoded.select("doc_id", "ids"), ranks, pattern)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
