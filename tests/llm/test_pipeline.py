from pyspark.sql import functions as F

import corpus_pipeline
from cohortflow.llm.common import settle
from cohortflow.llm.pii import personal_data_report
from cohortflow.llm.simhash import near_duplicates
from cohortflow.llm.suffix_dedup import repeats_report

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents):
    docs = {"input": documents}
    last = documents
    for name, stage in corpus_pipeline.STAGES:
        last = settle(stage(spark, last, SF), name)
        docs[name] = last
    columns = documents.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == list(docs)[1:]
    for name in list(docs)[1:-1]:
        assert docs[name].dtypes == columns
    ids = lambda name: sorted(r["doc_id"] for r in docs[name].select("doc_id").collect())
    assert ids("language_id") == sorted(r["doc_id"] for r in documents.where("text rlike '\\\\p{L}'").collect())
    groups = near_duplicates(docs["language_id"]).collect()
    assert ids("simhash_near_dedup") == sorted({r["component_id"] for r in groups})
    removed = {r["doc_id"]: r for r in repeats_report(docs["simhash_near_dedup"]).collect()}
    assert ids("suffix_array_dedup") == ids("simhash_near_dedup") == ids("personal_data")
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in docs["suffix_array_dedup"].collect()}
    assert all(0 <= r["n_bytes"] - r["n_removed"] - sizes[k] <= 6 * r["n_spans"] for k, r in removed.items())
    assert docs["personal_data"].where("n_chars <> length(text)").count() == 0
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in personal_data_report(docs["personal_data"]).collect())
    packed = docs["best_fit_packing"]
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids("personal_data")


def test_tables_without_labels_keep_texts_with_letters(spark, awkward):
    rows = awkward.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_stage(spark, rows, SF)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 6, 7, 8, 8, 9, 10, None], key=str)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_stages_take_awkward_rows(spark, awkward):
    for rows in (awkward, awkward.where("false")):
        last = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            last = settle(stage(spark, last, SF), name)
            assert last.dtypes == rows.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, last, SF).count() >= last.count()
        kept = sorted((r["doc_id"] for r in last.select("doc_id").collect()), key=str)
        assert kept == (sorted([1, 7, 8, 9, 10, None], key=str) if rows is awkward else [])
