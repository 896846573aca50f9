import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortflow.llm.language import WORD, detect, fit_on_documents, identify_languages, language_spans

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_prediction_ignores_label_source_and_id(documents):
    model = fit_on_documents(documents)
    texts = [r["text"] for r in documents.select("text").collect()]
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(documents).collect()}
    ids = [r["doc_id"] for r in documents.select("doc_id").collect()]
    assert [rows[i] for i in ids] == detect(texts, model)


def best_path(scores, penalty):
    """Value of the best labelling by plain dynamic programming."""
    value = scores[0].copy()
    for row in scores[1:]:
        value = np.maximum(value, value.max() - penalty) + row
    return value.max()


def test_labels_are_optimal_paths(documents):
    model = fit_on_documents(documents)
    words = [WORD.findall(r["text"].lower())[:300] for r in documents.select("text").limit(120).collect()]
    words += [a[:50] + b[:50] + a[50:70] for a, b in zip(words, words[1:])] + [[]]
    switched = 0
    for own, labels in zip(words, model.label(words)):
        if own:
            scores = model._lookup(own)
            got = scores[np.arange(len(own)), labels].sum() - model.penalty * (np.diff(labels) != 0).sum()
            assert abs(got - best_path(scores, model.penalty)) < 1e-6
            switched += bool((np.diff(labels) != 0).any())
    assert switched


def test_spans_of_mixed_text(documents):
    model = fit_on_documents(documents)
    one, two = (documents.where(f"lang = '{x}' AND length(text) > 1500").orderBy("doc_id").first()["text"][:600] for x in ("en", "de"))
    spans = language_spans(one + " " + two, model)
    assert {s[2] for s in spans} >= {"en", "de"} and spans[0][2] == "en" and spans[-1][2] == "de"
    assert language_spans(None, model) == [] and language_spans("12 34", model) == []


def test_awkward_rows(awkward, no_documents):
    rows = identify_languages(awkward).collect()
    assert len(rows) == awkward.count() and identify_languages(no_documents).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert by[1]["lang_pred"] == "en" and by[None]["held_out"] is False
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify_languages(unlabelled).collect()} == {"und"}
