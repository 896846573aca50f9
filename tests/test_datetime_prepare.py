from pyspark.sql import functions as F

from cohortflow.functions.datetime import _first_values, find_datetime_col, parse_datetime
from cohortflow.plans.prepare import prepare, status_text
from cohortflow.plans import standins as si
from fixture_paths import SF_SMALL


def test_find_datetime_col_rules(spark):
    a = spark.createDataFrame([("1", "x", "2020-01-01")], "id string, visit_time string, Created_Date string")
    assert find_datetime_col(a) == "Created_Date"           # create-date names win over generic ones
    b = spark.createDataFrame([("1", "x")], "id string, visit_time string")
    assert find_datetime_col(b) == "visit_time"
    rows = [(str(i), f"2020-01-0{i % 9 + 1}T00:00:00" if i % 4 else "junk") for i in range(10)]
    c = spark.createDataFrame(rows, "id string, recorded string")
    assert find_datetime_col(c) == "recorded"                # content: >= 60% ISO-like
    d = spark.createDataFrame([("1", "2020-01-01T00:00:00"), ("2", None)], "id string, when_ string")
    assert find_datetime_col(d) is None                      # fewer than 3 values


def test_parse_datetime_is_column_level(spark):
    mixed = spark.createDataFrame([("2020-01-02 03:04:05",), ("2020-01-03",)], "d string")
    got = [r.d for r in parse_datetime(mixed, "d").collect()]
    assert got[0] is not None and got[1] is None             # the first parser hit, so it applies to all
    dates = spark.createDataFrame([("2020-01-03",), ("20200104",)], "d string")
    got = [r.d for r in parse_datetime(dates, "d").orderBy("d").collect()]
    assert [g.day for g in got] == [3, 4]


def test_prepare_flow(spark):
    prep = prepare(spark, si.envelope(spark, SF_SMALL), selected=["lineitem"])
    assert prep.entity_types == ["lineitem", "person", "subject"] and prep.optional_entities == ["lineitem"]
    assert "o_orderpriority" in prep.categorical and "c_acctbal" in prep.numeric
    assert status_text(prep).startswith("Merged dataset rows: ")
    assert prep.merged.where(F.col("id_lineitem").isNotNull()).count() > 0


def test_only_the_first_values_of_a_column_count(spark):
    late = [(f"{i:04d}", "x" if i < 30 else "2020-01-01T00:00:00", "2021-05-05 10:00" if i < 20 else "n/a") for i in range(300)]
    df = spark.createDataFrame(late, "id string, a string, b string").repartition(7)
    assert find_datetime_col(df) == "b"                      # 20 of its first 30; a's dates come later
    assert find_datetime_col(df.drop("b")) is None
    assert find_datetime_col(df.withColumn("a", F.when(F.col("id") >= "0030", F.col("a")))) == "a"      # nulls are passed over
    plan = _first_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
