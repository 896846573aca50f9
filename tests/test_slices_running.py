import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortflow.operators.running import add_ranges, running, value_range
from cohortflow.operators.slices import first_per_key, latest_per_key


def test_latest_per_key_ties_nulls_and_all_null_group(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0),      # tie on 5.0 -> smallest id
            ("b", 4, None), ("b", 5, 2.0),                     # NULL ordered last
            ("c", 7, None), ("c", 6, None)]                    # all NULL -> still one row, smallest id
    df = spark.createDataFrame(rows, "k string, id int, t double")
    got = {r.k: r.id for r in latest_per_key(df, "k", "t", "id").collect()}
    assert got == {"a": 1, "b": 5, "c": 6}


def test_latest_per_key_timestamp_and_hot_key(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") < 15000, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.col("id"), F.timestamp_seconds(F.col("id") % 1000).alias("t"))
    out = {r.k: r.id for r in latest_per_key(df, "k", "t", "id").collect()}
    assert out["hot"] == 999
    assert len(out) == 8


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, id int")
    assert {r.k: r.id for r in first_per_key(df, "k", "id").collect()} == {"a": 1, "b": 2}


def test_ranged_running_sums_equal_single_window(spark):
    random.seed(1)
    data = [(g, float(x), random.randint(0, 5)) for g in ("p", "q") for x in random.sample(range(100000), 3000)]
    df = spark.createDataFrame(data, "g string, x double, c int")
    w = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ref = {(r.g, r.x): r.s for r in df.select("g", "x", F.sum("c").over(w).alias("s")).collect()}
    for n in (1, 7, None):
        ranged, k = add_ranges(df, "x", n)
        got = running(ranged, "x", ["g"], sums={"s": F.col("c")}, n_ranges=k)
        got = {(r.g, r.x): r.s for r in got.collect()}
        assert got == ref


def test_ranged_running_product(spark):
    df = spark.createDataFrame([(float(i), 1.0 - 1.0 / (i + 2)) for i in range(200)], "x double, f double")
    ranged, k = add_ranges(df, "x", 5)
    assert k == 5
    got = running(ranged, "x", [], products={"p": F.col("f")}, n_ranges=k).orderBy("x").collect()
    prod = 1.0
    for r in got:
        prod *= 1.0 - 1.0 / (r.x + 2)
        assert abs(r.p - prod) < 1e-12


def test_value_ranges_follow_the_order(spark):
    random.seed(4)
    values = [0.0, -0.0, 1e-310, 5e-324, 1e-300, float("inf"), float("-inf"), 1.0, 2.0, 4.0, 8.0, 1e300, -1e300]
    for _ in range(3000):
        x = random.choice([-1, 1]) * random.random() * 2.0 ** random.randint(-60, 60)
        values += [x, x * (1 + 2 ** -52), round(x, 2)]
    values += [2.0 ** k * (1 + s * 2 ** -52) for k in range(-1000, 1000, 7) for s in (-1, 0, 1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["r"] for r in df.select("x", value_range(F.col("x")).alias("r")).orderBy("x").collect()]
    assert got == sorted(got)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(value_range(F.col("x")).alias("r")).collect()
    assert odd[0]["r"] < min(got) and odd[1]["r"] > max(got)
