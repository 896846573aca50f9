from pyspark.sql import functions as F

from cohortflow.functions import clean_string, fmt_p, n_pct, round_r, to_num
from cohortflow.operators.flatten import fmt_double


def _one(spark, expr, data, schema="v string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_clean_string_tokens(spark):
    data = [("Initial_20_Diagnosis",), ("A_20__28_x_29_",), ("4_2d_NOT_20_SPECIFIED",), ("x_2018",),
            ("a_2f_b",), ("  padded \t",), ("a  b",), (None,), ("v_2e_1",)]
    got = _one(spark, clean_string("v"), data)
    assert got == ["Initial Diagnosis", "A (x)", "4-NOT SPECIFIED", "x 18", "a_b", "padded", "a b", None, "v.1"]


def test_clean_string_is_trim_on_plain_text(spark):
    data = [("Hello world",), (" x ",), ("no-tokens here",)]
    assert _one(spark, clean_string("v"), data) == ["Hello world", "x", "no-tokens here"]


def test_to_num(spark):
    data = [("1",), (" 12 ",), ("1e3",), ("-.5",), ("1d",), ("1f",), ("NaN",), ("abc",), ("",), (None,), ("Inf",)]
    got = _one(spark, to_num("v"), data)
    assert got[:4] == [1.0, 12.0, 1000.0, -0.5]
    assert got[4:10] == [None] * 6
    assert got[10] == float("inf")


def test_round_r_half_even_on_decimal_candidates(spark):
    data = [(2.675,), (0.125,), (-2.675,), (1.005,), (33.333333,), (0.5,), (None,)]
    got = _one(spark, round_r("v", 2), data, "v double")
    assert got == [2.67, 0.12, -2.67, 1.0, 33.33, 0.5, None]


def test_n_pct_and_fmt_p(spark):
    df = spark.createDataFrame([(1, 3, 0.0004), (2, 4, 0.05), (0, 0, None), (5, None, 0.12345)],
                               "n int, d int, p double")
    rows = df.select(n_pct("n", "d").alias("a"), fmt_p("p").alias("b")).collect()
    assert [r.a for r in rows] == ["1 (33.33%)", "2 (50%)", "0 (0%)", "0 (0%)"]
    assert [r.b for r in rows] == ["<0.001", "0.050", "—", "0.123"]


def test_fmt_double_15_significant(spark):
    data = [(23.0,), (68423.46,), (0.1 + 0.2,), (1e20,), (1e-5,), (0.0,), (-2.5,)]
    got = _one(spark, fmt_double(F.col("v")), data, "v double")
    assert got == ["23", "68423.46", "0.3", "1e+20", "1e-05", "0", "-2.5"]
