"""Corpus pipeline: five text operators chained over the documents table.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; a stage's
decisions take effect in its result (documents go, texts are cut or masked, ``n_chars`` follows
the text). Other columns, whatever their names, are carried along in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import settle, tokenizer_file
from cohortflow.llm.language import UNKNOWN, fit_on_documents, predict_languages
from cohortflow.llm.packing import pack_documents
from cohortflow.llm.pii import find_personal_data, mask
from cohortflow.llm.simhash import fingerprints, group_fingerprints
from cohortflow.llm.suffix_dedup import remove_repeats

SHINGLE, DISTANCE = 3, 3        # near-duplicate contract: words of a shingle, differing bits
REPEAT_BYTES = 200
CAPACITY = 2048


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("__row"), "text")


def _restored(carried: DataFrame, docs: DataFrame, text: str = "__row.text") -> DataFrame:
    """The columns of ``docs`` again, with another text and its length."""
    swap = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    changed = text != "__row.text"
    return carried.select(*[swap[c].alias(c) if changed and c in swap else F.col(f"__row.`{c}`") for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (null texts, no letters) go; without labels to learn from only these."""
    model = fit_on_documents(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict_languages(_carried(docs), model)
    return _restored(found.where(F.col("lang_pred") != UNKNOWN), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id stays (one row of it)."""
    keyed = _carried(docs).withColumn("__id", F.struct(F.col("__row.doc_id").isNull(), F.col("__row.doc_id"),
                                                       F.monotonically_increasing_id()))
    rows = settle(fingerprints_of(keyed), "rows")
    groups = group_fingerprints(rows.select(F.col("__row.doc_id").alias("doc_id"), "fp"), DISTANCE)
    stay = rows.select("__id", "fp").join(groups, "fp").groupBy("root").agg(F.min("__id").alias("__id")).select("__id")
    return _restored(rows.join(stay, "__id", "left_semi"), docs)


def fingerprints_of(keyed: DataFrame) -> DataFrame:
    whole = keyed.withColumn("__all", F.struct("__row", "__id")).select("__all", "text")
    return fingerprints(whole, SHINGLE, "__all").select("__all.*", "fp")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start at two places or more are cut out of the texts."""
    cut = remove_repeats(_carried(docs), REPEAT_BYTES, ("__row",), with_text=True)
    return _restored(cut, docs, "kept_text")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    found = find_personal_data(_carried(docs))
    return _restored(found.withColumn("__masked", mask(F.coalesce("text", F.lit("")), F.col("spans"))), docs, "__masked")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", repeats_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

# tokens, fingerprints and learned models cannot be said in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
