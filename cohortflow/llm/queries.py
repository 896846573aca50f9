"""Registered queries of the text operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import sql
from cohortflow.llm.ann import nearest
from cohortflow.llm.centroids import clusters_report
from cohortflow.llm.common import read_table, tokenizer_file
from cohortflow.llm.language import identify_languages
from cohortflow.llm.license_scan import license_report
from cohortflow.llm.packing import pack_documents
from cohortflow.llm.periodic_runs import runs_report
from cohortflow.llm.pii import personal_data_report
from cohortflow.llm.quality import quality_report
from cohortflow.llm.sentencepiece_codec import codec_report
from cohortflow.llm.simhash import near_duplicates
from cohortflow.llm.suffix_dedup import repeats_report
from cohortflow.llm.token_counts import count_tokens
from cohortflow.llm.warc import archive_report


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # alone in its workers, packing can keep more words than as a stage of the pipeline
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048,
                          max_chunks=600_000, max_bytes=96 << 20)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(read_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_report(read_table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(read_table(spark, sf_dir, "pages"))


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the license scan that SQL can say."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the quality rules that SQL can say."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def personal_data_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the personal data report that SQL can say."""
    return op3_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_quality_rules, op3_personal_data, op4_simhash, op5_sentencepiece, op6_nearest_neighbours,
        op7_token_counts, op8_suffix_dedup, op9_language_id, op10_best_fit_packing, op11_periodic_runs,
        op12_centroid_clustering, op13_warc, license_base_columns, quality_base_columns, personal_data_base_columns)
}

# The other operators' whole results cannot be said in SQL; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_centroid_clustering": sql.centroid_clustering(),
    "op13_warc": sql.archived_pages(),
    "license_base_columns": sql.license_base(),
    "quality_base_columns": sql.quality_base(),
    "personal_data_base_columns": sql.personal_data_base(),
}
