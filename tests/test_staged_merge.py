import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.merge import merge_entities
from cohortflow.operators.staged import heavy_keys, stage_merge


def parts(spark):
    subject = spark.createDataFrame(
        [(f"s{i}", "subject", f"p{i % 7}" if i % 5 else None) for i in range(60)] + [(None, "subject", "p1"), ("s3", "again", "p2")],
        "id string, name string, dst_id string")
    person = spark.createDataFrame([(f"p{i}", "person", i % 2 == 0) for i in range(6)] + [(None, "nobody", True)],
                                   "id string, name string, sex boolean")
    lab = spark.createDataFrame([(i, f"v{i}", None if i % 11 == 0 else "s2" if i % 3 == 0 else f"s{i % 80}") for i in range(400)],
                                "id long, `_link` string, dst_id string")
    visit = spark.createDataFrame([(f"e{i}", float(i), f"s{i % 9}") for i in range(30)], "id string, day double, dst_id string")
    return subject, person, [("lab", lab), ("visit", visit)]


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("heavy_rows", [5, 100_000])
@pytest.mark.parametrize("buckets", [1, 4])
def test_staged_merge_equals_merge(spark, heavy_rows, buckets):
    subject, person, entities = parts(spark)
    expected = merge_entities(subject, person, entities)
    staged = stage_merge(subject, person, entities, buckets, heavy_rows=heavy_rows)
    assert (staged.heavy is not None) == (heavy_rows == 5 and buckets == 4)
    got = staged.frame()
    assert got.columns == expected.columns and [f.dataType for f in got.schema] == [f.dataType for f in expected.schema]
    assert bag(got) == bag(expected)
    staged.drop()
    assert not any(spark.catalog.tableExists(t) for t in staged.tables)


def test_staged_merge_of_empty_and_of_no_entities(spark):
    subject, person, entities = parts(spark)
    none = [(n, e.where(F.lit(False))) for n, e in entities]
    assert bag(stage_merge(subject, person, none, 3).frame()) == bag(merge_entities(subject, person, none))
    assert bag(stage_merge(subject, person, [], 3).frame()) == bag(merge_entities(subject, person))
    assert stage_merge(subject.where(F.lit(False)), person, entities, 3).frame().count() == 0


def test_heavy_keys_are_above_the_mean_bucket(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 520, "warm")
                                     .otherwise(F.col("id").cast("string")).alias("k"))
    assert heavy_keys(df, "k", 4, 10) == ["hot"]           # a mean bucket has 250 rows
    assert heavy_keys(df, "k", 10, 10) == ["hot", "warm"]
    assert heavy_keys(df, "k", 10, 500) == [] and heavy_keys(df.where(F.lit(False)), "k", 10, 0) == []


def test_merge_of_staged_entities_has_no_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = stage_merge(*parts(spark), 4)
        plan = staged.frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 2 and not re.search(r"\bExchange\b", plan)
