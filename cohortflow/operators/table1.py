"""Grouped summary table ("Table 1") for any number of covariates in one pass.

Rows: a ``Count`` header; per covariate a main row (with the p-value in
two-group mode), then its statistic rows (numeric: ``Mean``/``Mode``) or level
rows (categorical: ``n (p%)`` over the non-missing pairs of the group), then a
``Missing`` row. Sub-rows are indented by three spaces. Output columns:
``ord, Covariate, <group label>, Everything else, P_value`` (two groups) or
``ord, Covariate, Everything`` (one group); ``ord`` gives the row order.

Work: one unpivot/distinct/count over the subject table gives the counts of every value in
both groups (materialised once). They are read twice: one pass gives totals, sums, requested levels
and the shape of the test tables; the second, knowing these, gives the tests' statistics, and for numeric
covariates counts by number for modes, deviations and ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.format import COUNT_SUFFIX, fmt_num, fmt_p, mean_sd, n_pct
from ..functions.numeric import round_r, to_num
from ..functions.text import is_missing_categorical
from ..session import materialize
from . import stats as st
from .finishers import SMALL_CELL
from .flatten import fmt_double
from .groups import ALL, G1, G2, SINGLE_LABEL, Grouping, assign_groups
from .montecarlo import DEFAULT_REPLICATES, monte_carlo_p

# Row labels and indentation.
INDENT = "   "
COUNT_ROW = "Count"
MEAN, MODE, MISSING = "Mean", "Mode", "Missing"
MEAN_SD = "Mean (SD)"   # optional statistic: mean and sample standard deviation
MISSING_ORD = 999


@dataclass
class Covariate:
    column: str
    values: Sequence[str] = field(default_factory=list)  # "Mean"/"Mode" or category levels


def _grp_cols(grouping: Grouping) -> list[tuple[str, str]]:
    if grouping.mode == "two":
        return [(G1, grouping.g1_label), (G2, grouping.g2_label)]
    return [(ALL, SINGLE_LABEL)]


def table1(df: DataFrame | None, covariates: Sequence[Covariate], ids: DataFrame | None = None,
           group_label: str | None = None, id_col: str = "id", seed: int = 42,
           replicates: int = DEFAULT_REPLICATES, grouping: Grouping | None = None,
           with_p: bool = True, pairs: DataFrame | None = None, with_test: bool = False) -> DataFrame:
    """Table 1 from a subject table ``df`` holding the covariate columns (e.g. the merged
    table), or from ``pairs`` (``id, covariate, value`` for every subject and requested
    covariate, see ``merge.subject_pairs``) with ``df`` then only the subject table
    (its ``id_col`` gives the group counts). ``with_test`` adds the name of the test behind each p-value."""
    if pairs is not None:
        spark = pairs.sparkSession
        covs = [c for c in covariates if c.column]
        grouping = grouping or assign_groups(df, ids, group_label, id_col)
    else:
        spark = df.sparkSession
        covs = [c for c in covariates if c.column and c.column in df.columns]
        grouping = grouping or assign_groups(df, ids, group_label, id_col)
    two = grouping.mode == "two"
    gcols = _grp_cols(grouping)

    header = {"ord": 0, "_label": COUNT_ROW}
    if two:
        header.update({G1: f"{grouping.n_g1}{COUNT_SUFFIX}", G2: f"{grouping.n_g2}{COUNT_SUFFIX}", "P_value": ""})
    else:
        header.update({ALL: f"{grouping.n_all}{COUNT_SUFFIX}"})
    grp_names = [g for g, _ in gcols]
    schema = "ord int, _label string, " + ", ".join(f"{g} string" for g in grp_names) + \
        (", P_value string" if two else "")
    head_df = spark.createDataFrame([tuple(header[k] for k in ["ord", "_label", *grp_names]
                                           + (["P_value"] if two else []))], schema)
    if not covs:
        return _finish(head_df, gcols, two, with_test)

    names = list(dict.fromkeys(c.column for c in covs))
    wide_counts = materialize(st.value_counts_wide(
        df, names, ids if two else None, id_col, pairs=None if pairs is None else pairs.where(F.col("covariate").isin(*names))))
    facts, level_counts = _facts(wide_counts, [(c.column, str(v)) for c in covs for v in c.values])
    kinds = {c: f["is_numeric"] for c, f in facts.items()}
    by_number = None
    if any(kinds.values()):
        by_number = materialize(st.numeric_counts(wide_counts.where(F.col("covariate").isin(*[c for c, k in kinds.items() if k]))))

    # row specs: (covariate, ord, row kind, level) - small, built from the request
    spec_rows = []
    for k, c in enumerate(covs, start=1):
        base = k * 1000
        numeric = bool(kinds.get(c.column))
        spec_rows.append((c.column, base, "main", None))
        if numeric:
            if MEAN in c.values:
                spec_rows.append((c.column, base + 1, "mean", None))
            if MODE in c.values:
                spec_rows.append((c.column, base + 2, "mode", None))
            if MEAN_SD in c.values:
                spec_rows.append((c.column, base + 3, "mean_sd", None))
            spec_rows.append((c.column, base + MISSING_ORD, "missing_num", None))
        else:
            for i, lvl in enumerate(c.values):
                spec_rows.append((c.column, base + 1 + i, "level", str(lvl)))
            spec_rows.append((c.column, base + MISSING_ORD, "missing_cat", None))
    spec = spark.createDataFrame(spec_rows, "covariate string, ord int, kind string, level string")
    spec_g = spec.select("*", F.explode(F.array(*[F.lit(g) for g in grp_names])).alias("grp"))

    # per (covariate, grp) totals and levels: rows of the report
    sides = list(zip(("1", "2"), grp_names))
    per = spark.createDataFrame(
        [(c, g, *(f[k + i] for k in ("tot", "den", "mis_cat", "mis_num", "nx", "mean"))) for c, f in facts.items() for i, g in sides],
        "covariate string, grp string, tot long, den long, mis_cat long, mis_num long, n_values long, mean double")
    lvl_counts = spark.createDataFrame(
        [(c, g, lvl, n[int(i) - 1]) for (c, lvl), n in level_counts.items() for i, g in sides],
        "covariate string, grp string, level string, n long")
    spreads = _spreads(by_number, facts) if by_number is not None else None
    num = (spreads.select("covariate", F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.col(f"mode{i}").alias("mode"), F.col(f"sd{i}").alias("sd")) for i, g in sides])).alias("s"))
        .select("covariate", "s.*") if spreads is not None
        else spark.createDataFrame([], "covariate string, grp string, mode double, sd double"))

    cells = (spec_g.join(per, ["covariate", "grp"], "left")
             .join(num, ["covariate", "grp"], "left")
             .join(lvl_counts, ["covariate", "grp", "level"], "left"))
    kind = F.col("kind")
    tot = F.coalesce(F.col("tot"), F.lit(0))
    text = (F.when(kind == "main", F.lit(""))
            .when(kind == "mean", F.when(F.col("n_values") > 0, fmt_num(round_r(F.col("mean"), 2))))
            .when(kind == "mode", F.when(F.col("n_values") > 0, fmt_double(F.col("mode"))))
            .when(kind == "mean_sd", mean_sd(F.col("mean"), F.col("sd")))
            .when(kind == "missing_num", n_pct(F.coalesce(F.col("mis_num"), F.lit(0)), tot))
            .when(kind == "missing_cat", n_pct(F.coalesce(F.col("mis_cat"), F.lit(0)), tot))
            .when(kind == "level", n_pct(F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("den"), F.lit(0)))))
    label = (F.when(kind == "main", F.col("covariate"))
             .when(kind == "mean", F.lit(INDENT + MEAN))
             .when(kind == "mode", F.lit(INDENT + MODE))
             .when(kind == "mean_sd", F.lit(INDENT + MEAN_SD))
             .when(kind.startswith("missing"), F.lit(INDENT + MISSING))
             .otherwise(F.concat(F.lit(INDENT), F.col("level"))))
    long = cells.select("ord", label.alias("_label"), "grp", text.alias("text"))
    wide = long.groupBy("ord", "_label").pivot("grp", grp_names).agg(F.first("text"))

    if two:
        if with_p:
            pv = covariate_p_values(wide_counts, facts, by_number, spreads, seed=seed, replicates=replicates)
            main_p = spec.where(F.col("kind") == "main").select("covariate", "ord") \
                .join(pv, "covariate", "left").select("ord", fmt_p(F.col("p")).alias("_p"), F.coalesce("test", F.lit("")).alias("_t"))
            wide = wide.join(main_p, "ord", "left")
            pcol, tcol = F.coalesce(F.col("_p"), F.lit("")), F.coalesce(F.col("_t"), F.lit(""))
        else:
            pcol, tcol = F.when(F.col("ord") % 1000 == 0, F.lit(None).cast("string")).otherwise(F.lit("")), F.lit("")
        wide = wide.select("ord", "_label", *grp_names, pcol.alias("P_value"), tcol.alias("Test"))
    else:
        wide = wide.select("ord", "_label", *grp_names)
    return _finish(head_df.unionByName(wide, allowMissingColumns=True), gcols, two, with_test)


def _finish(df: DataFrame, gcols, two: bool, with_test: bool = False) -> DataFrame:
    test = F.coalesce("Test", F.lit("")).alias("Test") if "Test" in df.columns else F.lit("").alias("Test")
    out = df.select("ord", F.col("_label").alias("Covariate"), *[F.col(g).alias(label) for g, label in gcols],
                    *(["P_value", *([test] if with_test else [])] if two else []))
    return out.orderBy("ord")


SUMS = ("tot", "den", "mis_cat", "mis_num", "nx", "sx", "C")


def _facts(wide_counts: DataFrame, requested: Sequence[tuple[str, str]]) -> tuple[dict, dict]:
    """What the first pass tells: {covariate: totals, kind and table shape}, {(covariate, level): (n1, n2)}."""
    facts: dict[str, dict] = {}
    levels = {}
    for r in st.value_summary(wide_counts, requested).collect():     # as many rows as the report has
        f = facts.setdefault(r["covariate"], {k + i: 0 for k in SUMS for i in "12"}
                             | {"n_nonblank": 0, "n_numeric": 0, "r": 0, "min_cell": None, "low": None, "high": None})
        for k in [k + i for k in SUMS for i in "12"] + ["n_nonblank", "n_numeric", "r"]:
            f[k] += r[k] or 0
        if r["r"]:
            f["min_cell"] = r["min_cell"] if f["min_cell"] is None else min(f["min_cell"], r["min_cell"])
            if f["low"] is None or r["low"] < f["low"]:
                f.update(low=r["low"], a=r["first1"], b=r["first2"])
            if f["high"] is None or r["high"] > f["high"]:
                f.update(high=r["high"], c=r["last1"], d=r["last2"])
        if r["level"] is not None:
            levels[r["covariate"], r["level"]] = (r["tot1"], r["tot2"])
    for f in facts.values():
        f["is_numeric"] = f["n_nonblank"] > 0 and f["n_numeric"] / f["n_nonblank"] >= st.NUMERIC_SHARE
        for i in "12":
            f[f"mean{i}"] = f[f"sx{i}"] / f[f"nx{i}"] if f[f"nx{i}"] else None
    return facts, levels


def _spreads(by_number: DataFrame, facts: dict) -> DataFrame:
    """Per numeric covariate and group: mode, sample variance around the known mean, standard deviation."""
    spark = by_number.sparkSession
    known = spark.createDataFrame([(c, *(f[k] for k in ("nx1", "mean1", "nx2", "mean2"))) for c, f in facts.items() if f["is_numeric"]],
                                  "covariate string, nx1 long, mean1 double, nx2 long, mean2 double")
    x = F.col("x")
    out = by_number.join(F.broadcast(known), "covariate").groupBy("covariate", "nx1", "mean1", "nx2", "mean2").agg(*[a for i in "12" for a in (
        F.min_by(x, F.when(F.col(f"c{i}") > 0, F.struct((-F.col(f"c{i}")).alias("n"), x.alias("x")))).alias(f"mode{i}"),
        F.sum(F.col(f"c{i}") * (x - F.col(f"mean{i}")) ** 2).alias(f"ss{i}"))])
    for i in "12":
        out = out.withColumn(f"v{i}", F.when(F.col(f"nx{i}") > 1, F.col(f"ss{i}") / (F.col(f"nx{i}") - 1)))
    return out.select("covariate", "nx1", "mean1", "nx2", "mean2", "mode1", "mode2", "v1", "v2",
                      F.sqrt("v1").alias("sd1"), F.sqrt("v2").alias("sd2"))


def covariate_p_values(wide_counts: DataFrame, facts: dict, by_number: DataFrame | None, spreads: DataFrame | None,
                       seed: int = 42, replicates: int = DEFAULT_REPLICATES) -> DataFrame:
    """``covariate, p, test`` for every covariate of two groups.

    Test inputs are one row per covariate, dealt out by covariate, so that exact tests run side by side;
    simulated covariates take their p from the simulation job.
    """
    spark = wide_counts.sparkSession
    categorical = {c: f for c, f in facts.items() if not f["is_numeric"]}
    inputs, mc = [], None
    if by_number is not None:
        welch = spreads.select("covariate", *[F.col(x).alias(f"w_{y}") for x, y in (
            ("nx1", "n1"), ("mean1", "m1"), ("v1", "v1"), ("nx2", "n2"), ("mean2", "m2"), ("v2", "v2"))])
        inputs.append(st.ranksum_of_counts(by_number).join(welch, "covariate", "full").withColumn("kind", F.lit("numeric")))
    if categorical:
        shape = spark.createDataFrame(
            [(c, f["r"], f["C1"] + f["C2"], f["C1"], f["C2"], f["min_cell"], *(f.get(k) for k in "abcd")) for c, f in categorical.items()],
            "covariate string, r long, N long, C1 long, C2 long, min_cell long, a long, b long, c long, d long")
        shape = shape.withColumn("test", F.when((F.col("C1") > 0) & (F.col("C2") > 0), st.chosen_test(F.col("r"), F.col("min_cell"))))
        ct = wide_counts.where(F.col("value").isNotNull() & F.col("covariate").isin(*categorical)).withColumnRenamed("value", "level")
        # a level of an r x 2 table adds (n1 C2 - n2 C1)^2 / ((n1 + n2) C1 C2); a single level is compared with equal shares
        n1, n2, c1, c2 = (F.col(k).cast("double") for k in ("n1", "n2", "C1", "C2"))
        part = F.when(F.col("r") == 1, (n1 - n2) ** 2 / (n1 + n2)).when(c1 * c2 > 0, (n1 * c2 - n2 * c1) ** 2 / ((n1 + n2) * c1 * c2))
        stat = ct.join(F.broadcast(shape.select("covariate", "r", "C1", "C2")), "covariate").groupBy("covariate").agg(
            F.sum(part).alias("stat"))
        free = F.when(F.col("r") == 1, 1).otherwise(F.col("r") - 1)
        tests = shape.join(stat, "covariate", "left").withColumn(
            "df", F.when(F.col("test") != "chisq_mc", free).cast("int"))
        if any(f["r"] > 2 and f["min_cell"] < SMALL_CELL for f in categorical.values()):
            tests = materialize(tests)
            mc = monte_carlo_p(ct, tests, replicates=replicates, seed=seed)
        inputs.append(tests.withColumn("kind", F.lit("categorical")))
    if not inputs:
        return spark.createDataFrame([], "covariate string, p double, test string")
    allt = inputs[0]
    for x in inputs[1:]:
        allt = allt.unionByName(x, allowMissingColumns=True)
    allt = allt.repartition(len(facts), "covariate")
    p = st.p_values(allt)
    if mc is not None:
        p = p.join(mc, "covariate", "left").select("covariate", "test", F.coalesce(F.col("p_mc"), F.col("p")).alias("p"))
    return p.select("covariate", F.when(~F.isnan("p"), F.col("p")).alias("p"), "test")
