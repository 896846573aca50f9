"""Distributed inputs of the group-comparison tests.

Everything starts from one long, compact frame of value counts
``(covariate, grp, value, n)`` over distinct (subject, covariate, value) triples:
a single unpivot + distinct + grouped count over the subject table (map-side
partial aggregation collapses fan-out duplicates before the shuffle). Every test
statistic below is a small aggregate of that frame; only the final p-value step
(one row per covariate) runs in Python, as a vectorised pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import to_num
from ..functions.text import is_missing_categorical, non_blank
from . import finishers as fin
from .groups import G1, G2, mark_groups
from .running import add_ranges, running

NUMERIC_SHARE = 0.90


def covariate_pairs(df: DataFrame, covariates: Sequence[str], id_col: str = "id") -> DataFrame:
    """Distinct ``(id, covariate, value)`` with values as text."""
    cols = [F.col(f"`{c}`").cast("string").alias(c) for c in covariates]
    wide = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), *cols)
    return wide.unpivot(["id"], list(covariates), "covariate", "value").distinct()


def value_counts_long(df: DataFrame | None, covariates: Sequence[str], ids: DataFrame | None = None,
                      id_col: str = "id", pairs: DataFrame | None = None) -> DataFrame:
    """``covariate, grp, value, n`` over distinct subject/value pairs (from ``df``, or
    from ready ``pairs`` of ``id, covariate, value`` such as ``merge.subject_pairs``)."""
    base = pairs if pairs is not None else covariate_pairs(df, covariates, id_col)
    pairs = mark_groups(base, ids, "id")
    return pairs.groupBy("covariate", "grp", "value").agg(F.count(F.lit(1)).alias("n"))


def value_counts_wide(df: DataFrame | None, covariates: Sequence[str], ids: DataFrame | None = None,
                      id_col: str = "id", pairs: DataFrame | None = None) -> DataFrame:
    """``covariate, value, n1, n2``: distinct subjects of the listed ids (or all) and of the others with each value.

    Rows of ``df`` are marked with their group before they are unpivoted, once per row and not per covariate.
    """
    if pairs is None:
        cols = [F.col(f"`{c}`").cast("string").alias(c) for c in covariates]
        marked = mark_groups(df.select(F.col(f"`{id_col}`").cast("string").alias("_id"), *cols), ids, "_id", "_grp")
        long = marked.unpivot(["_id", "_grp"], list(covariates), "covariate", "value").distinct()
    else:
        long = mark_groups(pairs.select("id", "covariate", "value"), ids, "id", "_grp")
    other = F.col("_grp") == G2
    return long.groupBy("covariate", "value").agg(F.count_if(~other).alias("n1"), F.count_if(other).alias("n2"))


def value_summary(wide: DataFrame, requested: Sequence[tuple[str, str]]) -> DataFrame:
    """One pass over ``value_counts_wide``: per covariate and requested (covariate, level), null for all other values,
    everything a summary table needs but modes, deviations and ranks. As many rows as are requested, and one per covariate.
    """
    spark = wide.sparkSession
    asked = spark.createDataFrame([tuple(r) for r in dict.fromkeys(requested)], "_c string, _l string")
    v = F.col("value")
    x, nb = to_num(v), non_blank(v)
    both = F.col("n1") + F.col("n2")
    known = F.when(v.isNotNull(), v)
    per = [agg for g in ("1", "2") for n in [F.col(f"n{g}")] for agg in (
        F.sum(n).alias(f"tot{g}"), F.sum(F.when(v.isNotNull() & (v != ""), n)).alias(f"den{g}"),
        F.sum(F.when(is_missing_categorical(v), n)).alias(f"mis_cat{g}"), F.sum(F.when(x.isNull(), n)).alias(f"mis_num{g}"),
        F.sum(F.when(x.isNotNull(), n)).alias(f"nx{g}"), F.sum(n * x).alias(f"sx{g}"), F.sum(F.when(v.isNotNull(), n)).alias(f"C{g}"),
        F.min_by(n, known).alias(f"first{g}"), F.max_by(n, known).alias(f"last{g}"))]
    joined = wide.join(F.broadcast(asked), (F.col("covariate") == F.col("_c")) & (v == F.col("_l")), "left")   # the request's size
    return joined.groupBy("covariate", F.col("_l").alias("level")).agg(
        *per, F.sum(F.when(nb, both)).alias("n_nonblank"), F.sum(F.when(nb & x.isNotNull(), both)).alias("n_numeric"),
        F.count("value").alias("r"), F.min(F.when(v.isNotNull(), F.least("n1", "n2"))).alias("min_cell"),
        F.min("value").alias("low"), F.max("value").alias("high"))


def numeric_counts(wide: DataFrame) -> DataFrame:
    """``covariate, x, c1, c2``: the counts by number (``"1"`` and ``"1.0"`` are one value)."""
    x = to_num(F.col("value"))
    return wide.where(x.isNotNull()).groupBy("covariate", x.alias("x")).agg(F.sum("n1").alias("c1"), F.sum("n2").alias("c2"))


def covariate_kinds(vc: DataFrame) -> DataFrame:
    """Numeric when >= 90% of non-blank distinct values parse as numbers."""
    v = F.col("value")
    nb = non_blank(v)
    agg = vc.groupBy("covariate").agg(
        F.sum(F.when(nb, F.col("n")).otherwise(0)).alias("n_nonblank"),
        F.sum(F.when(nb & to_num(v).isNotNull(), F.col("n")).otherwise(0)).alias("n_numeric"))
    share = F.when(F.col("n_nonblank") == 0, F.lit(0.0)).otherwise(F.col("n_numeric") / F.col("n_nonblank"))
    return agg.select("covariate", "n_nonblank", "n_numeric", (share >= NUMERIC_SHARE).alias("is_numeric"))


def kind_warnings(vc: DataFrame) -> DataFrame:
    """``covariate, card_numeric, table_numeric, warning``: where the card's rule (any value parses) and the table's (90%) differ.

    The card then offers Mean and Mode, which the table takes for levels and counts as such.
    """
    v = F.col("value")
    card = vc.groupBy("covariate").agg(F.coalesce(F.max(to_num(v).isNotNull()), F.lit(False)).alias("card_numeric"))
    j = card.join(covariate_kinds(vc), "covariate")
    text = F.when(F.col("card_numeric") & ~F.col("is_numeric"), F.concat(
        F.lit("only "), F.round(100 * F.col("n_numeric") / F.col("n_nonblank"), 1).cast("string"),
        F.lit("% of the values are numbers: statistics count as levels")))
    return j.select("covariate", "card_numeric", F.col("is_numeric").alias("table_numeric"), text.alias("warning"))


def numeric_values(vc: DataFrame) -> DataFrame:
    """Numeric values regrouped by number (``"1"`` and ``"1.0"`` are one value)."""
    x = to_num(F.col("value"))
    return (vc.where(x.isNotNull()).groupBy("covariate", "grp", x.alias("x"))
            .agg(F.sum("n").alias("n")))


def numeric_summary(vc: DataFrame) -> DataFrame:
    """Per covariate and group: pair count, missing (unparseable) count, mean and mode."""
    x = to_num(F.col("value"))
    tot = vc.groupBy("covariate", "grp").agg(
        F.sum("n").alias("n_total"),
        F.sum(F.when(x.isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    nv = numeric_values(vc)
    mom = nv.groupBy("covariate", "grp").agg(
        F.sum("n").alias("n_values"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"),
        F.min_by("x", F.struct((-F.col("n")).alias("neg_n"), F.col("x").alias("x"))).alias("mode"))
    # sample standard deviation, second pass around the mean (one row per covariate x group joined back)
    dev = nv.join(F.broadcast(mom.select("covariate", "grp", "mean", "n_values")), ["covariate", "grp"]) \
        .groupBy("covariate", "grp").agg(
            F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2).alias("_ss"), F.first("n_values").alias("_nv"))
    sd = dev.select("covariate", "grp", F.when(F.col("_nv") > 1, F.sqrt(F.col("_ss") / (F.col("_nv") - 1))).alias("sd"))
    return tot.join(mom, ["covariate", "grp"], "left").join(sd, ["covariate", "grp"], "left")


def welch_stats(vc: DataFrame) -> DataFrame:
    """n, mean and sample variance per group (two passes over the value counts: stable)."""
    nv = numeric_values(vc).where(F.col("grp").isin(G1, G2))
    m = nv.groupBy("covariate", "grp").agg(F.sum("n").alias("cnt"),
                                           (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"))
    dev = nv.join(F.broadcast(m), ["covariate", "grp"]).groupBy("covariate", "grp", "cnt", "m").agg(
        F.sum(F.col("n") * (F.col("x") - F.col("m")) ** 2).alias("ss"))
    dev = dev.withColumn("v", F.when(F.col("cnt") > 1, F.col("ss") / (F.col("cnt") - 1)))
    g = lambda name, c: F.max(F.when(F.col("grp") == name, F.col(c)))
    return dev.groupBy("covariate").agg(g(G1, "cnt").alias("w_n1"), g(G1, "m").alias("w_m1"),
                                        g(G1, "v").alias("w_v1"), g(G2, "cnt").alias("w_n2"),
                                        g(G2, "m").alias("w_m2"), g(G2, "v").alias("w_v2"))


def ranksum_stats(vc: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """n1, n2, rank sum of group 1 (mid-ranks for ties), sum(t^3 - t), any ties.

    Ranks come from running counts over the sorted distinct values of each
    covariate, computed range by range (no single-task window).
    """
    nv = numeric_values(vc).where(F.col("grp").isin(G1, G2))
    per = nv.groupBy("covariate", "x").agg(
        F.sum(F.when(F.col("grp") == G1, F.col("n")).otherwise(0)).alias("c1"),
        F.sum(F.when(F.col("grp") == G2, F.col("n")).otherwise(0)).alias("c2"))
    return ranksum_of_counts(per, n_ranges)


def ranksum_of_counts(per: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``ranksum_stats`` from counts by number (covariate, x, c1, c2)."""
    per = per.withColumn("c", F.col("c1") + F.col("c2"))
    per, n_ranges = add_ranges(per, "x", n_ranges)
    r = running(per, "x", ["covariate"], sums={"cum": F.col("c")}, n_ranges=n_ranges)
    mid = F.col("cum") - F.col("c") + (F.col("c") + 1) / 2.0
    c = F.col("c").cast("double")
    return r.groupBy("covariate").agg(
        F.sum("c1").alias("rs_n1"), F.sum("c2").alias("rs_n2"),
        F.sum(F.col("c1") * mid).alias("rs_r1"),
        F.sum(c * c * c - c).alias("rs_ties"),
        F.max(F.col("c") > 1).alias("rs_has_ties"))


def contingency(vc: DataFrame) -> DataFrame:
    """Level x group counts (NULL level dropped; empty and "None" kept as levels)."""
    ok = vc.where(F.col("value").isNotNull() & F.col("grp").isin(G1, G2))
    return ok.groupBy("covariate", F.col("value").alias("level")).agg(
        F.sum(F.when(F.col("grp") == G1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("grp") == G2, F.col("n")).otherwise(0)).alias("n2"))


def chosen_test(r: Column, min_cell: Column) -> Column:
    """Test of an r x 2 table by its smallest observed cell."""
    small = min_cell < fin.SMALL_CELL
    return (F.when((r == 2) & small, F.lit("fisher")).when(r == 2, F.lit("chisq"))
            .when(small, F.lit("chisq_mc")).otherwise(F.lit("chisq")))


def contingency_tests(ct: DataFrame) -> DataFrame:
    """Per covariate: table shape, test choice and Pearson statistic.

    Choice on observed counts: 2x2 with a cell < 5 -> Fisher; 2x2 -> Pearson;
    otherwise a cell < 5 -> Monte-Carlo; else Pearson. A single-level table is a
    goodness-of-fit test against equal group shares.
    """
    tot = ct.groupBy("covariate").agg(
        F.count(F.lit(1)).alias("r"), F.sum("n1").alias("C1"), F.sum("n2").alias("C2"),
        F.min(F.least("n1", "n2")).alias("min_cell"),
        F.min_by("n1", "level").alias("a"), F.min_by("n2", "level").alias("b"),
        F.max_by("n1", "level").alias("c"), F.max_by("n2", "level").alias("d"))
    tot = tot.withColumn("N", F.col("C1") + F.col("C2"))
    j = ct.join(F.broadcast(tot.select("covariate", "r", "C1", "C2", "N")), "covariate")
    rt = (F.col("n1") + F.col("n2")).cast("double")
    e1, e2 = rt * F.col("C1") / F.col("N"), rt * F.col("C2") / F.col("N")
    h1, h2 = F.col("N") / 2.0, F.col("N") / 2.0
    contrib = F.when(F.col("r") == 1, (F.col("n1") - h1) ** 2 / h1 + (F.col("n2") - h2) ** 2 / h2) \
        .otherwise((F.col("n1") - e1) ** 2 / e1 + (F.col("n2") - e2) ** 2 / e2)
    stat = j.groupBy("covariate").agg(F.sum(contrib).alias("stat"))
    both = (F.col("C1") > 0) & (F.col("C2") > 0)
    test = F.when(both, chosen_test(F.col("r"), F.col("min_cell")))
    df_ = F.when(F.col("r") == 1, F.lit(1)).otherwise(F.col("r") - 1)
    out = tot.join(stat, "covariate").withColumn("test", test)
    return out.select(
        "covariate", "r", "N", "C1", "C2", "min_cell", "test", "stat",
        F.when(F.col("test") == "chisq_mc", F.lit(None)).otherwise(df_).cast("int").alias("df"),
        "a", "b", "c", "d")


# --------------------------------------------------------------------------- p-value finisher
P_INPUTS = ["kind", "test", "rs_n1", "rs_n2", "rs_r1", "rs_ties", "rs_has_ties",
            "w_n1", "w_m1", "w_v1", "w_n2", "w_m2", "w_v2", "stat", "df", "a", "b", "c", "d"]


def _p_row(r) -> tuple[float, str | None]:
    """p-value and the test it comes from."""
    f = lambda k: (None if pd.isna(r[k]) else r[k])
    if r["kind"] == "numeric":
        n1, n2 = f("rs_n1") or 0, f("rs_n2") or 0
        if n1 <= 0 or n2 <= 0:
            return float("nan"), None
        p = fin.ranksum_p(int(n1), int(n2), float(r["rs_r1"]), float(r["rs_ties"]), bool(r["rs_has_ties"]))
        if p == p:
            return p, "ranksum"
        # rank-sum undefined -> Welch
        return fin.welch_p(f("w_n1") or 0, f("w_m1"), f("w_v1"), f("w_n2") or 0, f("w_m2"), f("w_v2")), "welch"
    test = f("test")
    if test == "fisher":
        return fin.fisher_2x2_p(r["a"], r["b"], r["c"], r["d"]), test
    if test == "chisq":
        return fin.chisq_sf(float(r["stat"]), float(r["df"])), test
    return float("nan"), test


@F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("test", T.StringType())]))
def p_value_udf(s: pd.DataFrame) -> pd.DataFrame:
    """Vectorised over a batch of covariate rows (one row per covariate)."""
    return pd.DataFrame([_p_row(r) for _, r in s.iterrows()], columns=["p", "test"])


def p_values(tests: DataFrame) -> DataFrame:
    """``covariate, p, test`` from a frame holding the P_INPUTS columns (missing ones are NULL)."""
    cols = []
    for c in P_INPUTS:
        cols.append(F.col(c) if c in tests.columns else F.lit(None).alias(c))
    return tests.select("covariate", p_value_udf(F.struct(*cols)).alias("r")).select("covariate", "r.p", "r.test")


@F.pandas_udf(T.DoubleType())
def chisq_p_udf(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Asymptotic upper-tail chi-square probability."""
    return pd.Series([fin.chisq_sf(float(x), float(k)) if pd.notna(x) and pd.notna(k) else float("nan")
                      for x, k in zip(stat, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_p_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact probability of the 2x2 table [[a, b], [c, d]]."""
    return pd.Series([fin.fisher_2x2_p(*v) if all(pd.notna(x) for x in v) else float("nan")
                      for v in zip(a, b, c, d)], dtype="float64")
