import re
from collections import Counter

from pyspark.sql import functions as F

from cohortflow.llm.quality import (QualityRule, cascade, default_rules, draw_sample, judge_quality, plan_cascade, quality_report,
                                    text_counts)


def brute(text):
    x = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return (len(words), sum(map(len, words)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(rows, by_id):
    for r in rows:
        expected = brute(by_id(r))
        assert tuple(r[c] for c in NAMES) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_documents_against_brute_force(documents, texts):
    rows = quality_report(documents).collect()
    assert len(rows) == len(texts)
    check(rows, lambda r: texts[r["doc_id"]])
    assert sum(r["kept"] for r in rows) > len(rows) / 2


CASES = ["a b c d e a b c d e", "a b c d e f a b c d e", "x " * 40, "one\ntwo\none\n \n\none", "a b c d\x0be f\x0cg\rh i\tj",
         "# * $ % & | < >", "é日😀 " * 12, None, "", "p q r s t u p q r s t u p q r s t"]


def test_cases_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    check(quality_report(df).collect(), lambda r: CASES[r["doc_id"]])


def test_awkward_rows(awkward, no_documents):
    rows = quality_report(awkward).collect()
    assert len(rows) == awkward.count() and quality_report(no_documents).count() == 0
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))


def test_order_changes_cost_not_verdict(documents):
    counted, rules = text_counts(documents), list(default_rules())
    verdict = lambda order: {r[0]: r[1] for r in counted.select("doc_id", cascade(order).isNull()).collect()}
    assert verdict(rules) == verdict(rules[::-1]) == {r["doc_id"]: r["kept"] for r in judge_quality(documents).collect()}


def test_cascade_runs_by_rejection_per_cost(documents):
    counted = text_counts(documents)
    rules = (QualityRule("never", F.lit(False)), QualityRule("always", F.col("n_words") >= 0))
    plan = plan_cascade(counted, rules)
    assert [p["rule"].name for p in plan] == ["always", "never"]
    assert plan[0]["selectivity"] == 1.0 and all(p["cost"] > 0 for p in plan)


def test_sample_does_not_grow_with_partitions(spark):
    df = spark.range(40000).selectExpr("id AS doc_id", "concat('text ', id % 9000) AS text")
    for parts in (1, 64):
        n = draw_sample(df.repartition(parts), 2000).count()
        assert 1700 < n < 2300
    assert draw_sample(df.limit(50), 2000).count() == 50 and draw_sample(df.where("false")).count() == 0
