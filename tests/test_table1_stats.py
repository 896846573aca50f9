import math

import numpy as np
from pyspark.sql import functions as F

from cohortflow.operators import finishers as fin
from cohortflow.operators import stats as st
from cohortflow.operators.montecarlo import monte_carlo_p
from cohortflow.operators.table1 import Covariate, table1


def test_finishers_known_values():
    assert math.isclose(fin.fisher_2x2_p(3, 1, 1, 3), 0.4857142857, rel_tol=1e-9)
    assert math.isclose(fin.chisq_sf(4.915309, 4), 0.2961, abs_tol=5e-5)
    assert math.isclose(fin.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert fin.ranksum_exact_p(0, 3, 3) == 0.1
    assert math.isclose(fin.ranksum_exact_p(0, 5, 5), 2 / 252)
    assert math.isclose(fin.ranksum_exact_p(3, 4, 5), 14 / 126)
    assert math.isclose(fin.chisq_statistic(np.array([[10, 20], [30, 40]])), 0.79365079, rel_tol=1e-7)
    # all values equal: rank-sum undefined, Welch "constant data" -> both NaN
    assert math.isnan(fin.ranksum_p(60, 60, 60 * 121 / 2.0, 120 ** 3 - 120, True))
    assert math.isnan(fin.welch_p(3, 1.0, 0.0, 3, 1.0, 0.0))


def _cohort(spark):
    rows = [("1", "10", "M", "x"), ("2", "20", "F", "5"), ("3", "20", None, "y"), ("4", "", "None", "6"),
            ("5", "40", "", "z"), ("6", "50", "M", "7"), ("6", "60", "M", "7")]
    return spark.createDataFrame(rows, "id string, age string, sex string, half string")


def test_table1_two_group_cells(spark):
    ids = spark.createDataFrame([(" 1 ",), ("2",), ("3",), ("zz",)], "id string")
    covs = [Covariate("age", ["Mean", "Mode"]), Covariate("sex", ["M", "F"]), Covariate("half", ["Mean", "x"]),
            Covariate("missing_col", ["x"])]
    t = table1(_cohort(spark), covs, ids, "uploaded").collect()
    cells = {r.ord: (r.Covariate, r.uploaded, r["Everything else"], r.P_value) for r in t}
    assert cells[0] == ("Count", "3 (Count)", "3 (Count)", "")
    assert cells[1001] == ("   Mean", "16.67", "50", "")
    assert cells[1002] == ("   Mode", "20", "40", "")
    assert cells[1000][0] == "age" and cells[1000][3] not in ("", None)
    # sex: G1 pairs M, F, NULL -> denominators exclude NULL and ""; "None" counts in the denominator
    assert cells[2001] == ("   M", "1 (50%)", "1 (50%)", "")
    assert cells[2002] == ("   F", "1 (50%)", "0 (0%)", "")
    assert cells[2999] == ("   Missing", "1 (33.33%)", "2 (66.67%)", "")
    # "half" is 50% numeric -> categorical; "Mean" becomes a level with no hits
    assert cells[3001] == ("   Mean", "0 (0%)", "0 (0%)", "")
    assert cells[3002] == ("   x", "1 (33.33%)", "0 (0%)", "")
    assert cells[1999] == ("   Missing", "0 (0%)", "1 (25%)", "")
    assert all(r.Covariate != "missing_col" for r in t)


def test_table1_single_group(spark):
    t = table1(_cohort(spark), [Covariate("sex", ["M"])]).collect()
    assert t[0]["Everything"] == "6 (Count)" and "P_value" not in t[0].asDict()
    assert [(r.Covariate, r["Everything"]) for r in t[1:]] == [("sex", ""), ("   M", "2 (50%)"),
                                                                ("   Missing", "3 (50%)")]


def test_table1_ids_outside_cohort_fall_back_to_single(spark):
    ids = spark.createDataFrame([("nobody",)], "id string")
    t = table1(_cohort(spark), [Covariate("sex", ["M"])], ids, "x")
    assert "Everything" in t.columns


def test_contingency_one_level_is_goodness_of_fit(spark):
    df = spark.createDataFrame([(str(i), "a") for i in range(30)], "id string, v string")
    ids = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    t = st.contingency_tests(st.contingency(st.value_counts_long(df, ["v"], ids))).first()
    assert (t.r, t.test, t.df) == (1, "chisq", 1)
    assert math.isclose(t.stat, (10 - 15) ** 2 / 15 * 2)


def test_monte_carlo_independent_of_partitioning(spark):
    rows = [(str(i), f"L{i % 6}") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, v string")
    ids = spark.createDataFrame([(str(i),) for i in range(0, 40, 3)], "id string")
    ct = st.contingency(st.value_counts_long(df, ["v"], ids))
    tests = st.contingency_tests(ct)
    assert tests.first().test == "chisq_mc"
    p2 = monte_carlo_p(ct.repartition(2), tests, replicates=2000).first().p_mc
    p7 = monte_carlo_p(ct.repartition(7), tests, replicates=2000).first().p_mc
    assert p2 == p7 and 0 < p2 <= 1
    other_seed = monte_carlo_p(ct, tests, replicates=2000, seed=7).first().p_mc
    assert abs(other_seed - p2) < 0.05
    stat = tests.first().stat
    assert abs(p2 - fin.chisq_sf(stat, 5)) < 0.15   # close to the asymptotic value


def test_ranksum_mid_ranks(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "2"), ("3", "2"), ("4", "3"), ("5", "5")], "id string, v string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    r = st.ranksum_stats(st.value_counts_long(df, ["v"], ids), n_ranges=2).first()
    assert (r.rs_n1, r.rs_n2, r.rs_r1, r.rs_ties, r.rs_has_ties) == (2, 3, 1 + 2.5, 6.0, True)


def test_table1_mean_sd_and_report_sink(spark, tmpdir_path):
    import os
    from cohortflow.sources.sinks import write_report
    t = table1(_cohort(spark), [Covariate("age", ["Mean (SD)"])])
    rows = {r.ord: (r.Covariate, r["Everything"]) for r in t.collect()}
    # age values 10, 20, 20, 40, 50, 60 -> mean 33.33, sd 19.66
    assert rows[1003] == ("   Mean (SD)", "33.33 (19.66)")
    out = os.path.join(tmpdir_path, "t1")
    write_report(t, out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text.splitlines()[0] == "ord,Covariate,Everything" and "Mean (SD)" in text


def test_monte_carlo_goodness_of_fit(spark):
    df = spark.createDataFrame([(str(i), "a") for i in range(9)], "id string, v string")
    ids = spark.createDataFrame([("0",), ("1",)], "id string")
    ct = st.contingency(st.value_counts_long(df, ["v"], ids))
    tests = st.contingency_tests(ct)
    t = tests.first()
    assert (t.r, t.test) == (1, "chisq_mc")          # 2 vs 7: a cell under 5
    p = monte_carlo_p(ct, tests, replicates=4000).first().p_mc
    # exact: P(|Bin(9, .5) - 4.5| >= 2.5) = 2 * P(X <= 2) = 2 * 46 / 512
    assert abs(p - 92 / 512) < 0.03
