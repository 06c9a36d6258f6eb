"""The operators of this package applied to whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import bpe, chat, decontaminate, license_scan, ngram_join, pii, quality_classifier, quality_rules, suffix_dedup, warc
from larkspur.llm._shared import new_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def license_scan_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over files that are whole licences; the tables have these in parts only."""
    files = spark.createDataFrame([(i, text) for i, _, text in license_scan.usual_files()], "doc_id long, text string")
    return license_scan.license_scan(files, license_scan.known_digests(spark)).select("doc_id", "license_id", "is_license")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.fitted_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat.conversation_digests(chat.format_windows(given.unionByName(added)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, license_scan_of_files, op2_ngram_jaccard_join, op3_suffix_array_dedup, op4_quality_rules, op5_quality_classifier, op6_byte_bpe, op7_warc, op8_chat_windows, op9_pii, op10_decontaminate,
    )
}
#: What each usual file is, from how it was made.
FILES_SQL = "SELECT n::BIGINT AS doc_id, l AS license_id, l IS NOT NULL AS is_license FROM (VALUES " + ", ".join(f"({i}, " + (f"'{name}'" if name else "NULL") + ")" for i, name, _ in license_scan.usual_files()) + ") v(n, l)"
ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan.license_scan_sql(), "license_scan_of_files": FILES_SQL, "op7_warc": warc.ARCHIVES_SQL, "op8_chat_windows": chat.DIGESTS_SQL}
