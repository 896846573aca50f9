"""The registered queries: each reads the driver's tables in full through the
stand-in entity frames and returns one DataFrame. Double columns are rounded to
9 decimals so a value hash does not depend on floating-point association."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import distribution as ds
from ..operators import stats as st
from ..operators import survival as sv
from ..operators.flatten import flatten_entity, flatten_summary, union_members
from ..operators.groups import group_counts
from ..operators.slices import first_per_key, latest_per_key
from ..operators.merge import Merge, subject_pairs, union_pairs
from ..operators.staged import stage_merge
from ..operators.montecarlo import DEFAULT_REPLICATES, monte_carlo_p
from ..operators.table1 import Covariate, table1
from ..session import materialize, shared_path
from ..sources.envelope import entity_types, optional_entities
from ..sources.sinks import write_report
from ..sources.subject_ids import subject_id_upload
from . import standins as si

RISK_BREAKS = [float(b) for b in range(0, 11)]


def r9(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), 9).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# ------------------------------------------------------------------ survival
def os_frame(spark, d, ids=None):
    return sv.overall_survival(si.timing(spark, d), si.survival_characteristic(spark, d), ids=ids)


def efs_frame(spark, d, ids=None):
    return sv.event_free_survival(si.efs_subject(spark, d), si.timing(spark, d),
                                  subject_tiebreak="record_key", ids=ids)


def os_grouped(spark, d):
    os_ = os_frame(spark, d)
    ids = si.region_ids(spark, d).select(F.col("id").cast("bigint").alias("_gid"))
    marked = os_.join(ids, os_.subject_id == ids._gid, "left")
    return marked.select("subject_id", "time_years", "event",
                         F.when(F.col("_gid").isNotNull(), "G1").otherwise("G2").alias("grp"))


def os_text_dates(spark, d):
    """Overall survival from create dates kept as text."""
    text = lambda df: df.withColumn("created_datetime", F.date_format("created_datetime", "yyyy/MM/dd'T'HH:mm:ss'Z'"))
    return sv.overall_survival(text(si.timing(spark, d)), text(si.survival_characteristic(spark, d)))


def os_without_dates(spark, d):
    """Overall survival from records without create dates: the highest ages are taken."""
    return sv.overall_survival(*[f(spark, d).drop("created_datetime") for f in (si.timing, si.survival_characteristic)])


def efs_without_dates(spark, d):
    """Event-free survival where subject records carry no date: the first record is taken."""
    return sv.event_free_survival(si.efs_subject(spark, d).drop("created_datetime"), si.timing(spark, d),
                                  subject_tiebreak="record_key")


SURVIVAL = {
    "overall_survival_text_dates": lambda s, d: r9(os_text_dates(s, d)),
    "overall_survival_without_dates": lambda s, d: r9(os_without_dates(s, d)),
    "event_free_survival_without_dates": lambda s, d: r9(efs_without_dates(s, d)),
    "km_efs_uploaded_ids": lambda s, d: r9(sv.kaplan_meier(efs_frame(s, d, si.region_ids(s, d)))),
    "overall_survival": lambda s, d: r9(os_frame(s, d)),
    "event_free_survival": lambda s, d: r9(efs_frame(s, d)),
    "km_overall_survival": lambda s, d: r9(sv.kaplan_meier(os_frame(s, d))),
    "km_event_free_survival": lambda s, d: r9(sv.kaplan_meier(efs_frame(s, d))),
    "km_ship_delay": lambda s, d: r9(sv.kaplan_meier(si.ship_delay(s, d))),
    "km_os_uploaded_ids": lambda s, d: r9(sv.kaplan_meier(sv.restrict_to_ids(os_frame(s, d),
                                                                             si.region_ids(s, d)))),
    "km_os_by_group": lambda s, d: r9(sv.kaplan_meier(os_grouped(s, d), by="grp")),
    "km_median_os": lambda s, d: r9(sv.km_median(sv.kaplan_meier(os_grouped(s, d), by="grp"), by="grp")),
    "km_median_ship_delay": lambda s, d: r9(sv.km_median(sv.kaplan_meier(si.ship_delay(s, d)))),
    "km_risk_table_os": lambda s, d: r9(sv.km_risk_table(os_frame(s, d), RISK_BREAKS)),
    "km_curve_os": lambda s, d: r9(sv.km_curve_points(sv.kaplan_meier(os_frame(s, d)))),
}


# ------------------------------------------------------------------ envelope, flatten, merge
def flat(spark, d, name):
    return flatten_entity(si.envelope(spark, d), name)


def merge_parts(spark, d, with_lineitem=False):
    env = si.envelope(spark, d)
    members = union_members(env)
    subject, person, line = (flatten_entity(env, n, members=members) for n in ("subject", "person", "lineitem"))
    return Merge(subject, person, [("lineitem", line)] if with_lineitem else [])


def merged(spark, d, with_lineitem=False):
    return merge_parts(spark, d, with_lineitem).frame()


def staged_merge(spark, d):
    parts = merge_parts(spark, d, True)
    return stage_merge(parts.subject, parts.person, parts.entities)


FLATTEN = {
    "entity_types": lambda s, d: entity_types(si.envelope(s, d)),
    "optional_entities": lambda s, d: optional_entities(si.envelope(s, d)),
    "flatten_summary": lambda s, d: flatten_summary(si.envelope(s, d)),
    "flatten_person": lambda s, d: flat(s, d, "person"),
    "flatten_subject": lambda s, d: flat(s, d, "subject"),
    "flatten_lineitem": lambda s, d: flat(s, d, "lineitem"),
    "flatten_json_person": lambda s, d: flatten_entity(si.json_envelope(s, d), "person"),
    "flatten_json_subject": lambda s, d: flatten_entity(si.json_envelope(s, d), "subject"),
    "flatten_json_lineitem": lambda s, d: flatten_entity(si.json_envelope(s, d), "lineitem"),
    "merge_subject_person": lambda s, d: merged(s, d),
    "merge_with_lineitem": lambda s, d: merged(s, d, True),
    "merge_with_lineitem_staged": lambda s, d: staged_merge(s, d).frame(),
    "dataset_shape": lambda s, d: merge_parts(s, d, True).shape(),
    "column_types": lambda s, d: r9(merge_parts(s, d, True).column_types()),
}


# ------------------------------------------------------------------ distribution
DISTRIBUTION = {
    "distribution_priority": lambda s, d: r9(ds.percentage_distribution(merged(s, d), "o_orderpriority")),
    "distribution_segment_fanout": lambda s, d: r9(ds.percentage_distribution(merged(s, d, True),
                                                                             "c_mktsegment")),
    "distribution_returnflag_export": lambda s, d: r9(ds.distribution_export(
        ds.percentage_distribution(merged(s, d, True), "l_returnflag"))),
    "covariate_values_segment": lambda s, d: ds.covariate_values(merged(s, d), "c_mktsegment"),
    "covariate_kind": lambda s, d: ds.covariate_kind(merged(s, d, True), ["l_quantity", "c_mktsegment"]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**SURVIVAL, **FLATTEN, **DISTRIBUTION}


# ------------------------------------------------------------------ Table 1 and group tests

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CUSTOMER_COVARIATES = [
    Covariate("c_acctbal", ["Mean", "Mode"]),
    Covariate("c_mktsegment", SEGMENTS),
    Covariate("nation", ["NATION_0", "NATION_5", "NATION_10"]),
    Covariate("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]),
    Covariate("o_orderstatus", ["F", "O", "P"]),
    Covariate("o_totalprice", ["Mean"]),
]
CUSTOMER_KINDS = {"c_acctbal": "numeric", "o_totalprice": "numeric"}
LABEL_COVARIATES = [Covariate("toxicity", ["toxic", "clean"]), Covariate("quality_label", ["high"])]
REGION_LABEL = "region_0_ids"
LANG_LABEL = "es_docs"


def _t1_customers(s, d, two=True, with_p=True):
    ids = si.region_ids(s, d) if two else None
    return table1(si.customer_cohort(s, d), CUSTOMER_COVARIATES, ids, REGION_LABEL, with_p=with_p, with_test=with_p)


CONSTANT_COVARIATES = [Covariate("constant", ["Mean", "Mode", "Mean (SD)"]), Covariate("one_level", ["yes", "no"])]


def _t1_constant(s, d):
    """Covariates without any spread: no rank-sum, no t-test, a table of one level."""
    cohort = si.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("7").alias("constant"),
                                               F.when(F.col("c_acctbal").isNotNull(), "yes").alias("one_level"))
    return table1(cohort, CONSTANT_COVARIATES, si.region_ids(s, d), REGION_LABEL, with_test=True)


def _exact_ranksum(s, d):
    """Balances summed per nation, region 0 against the others: groups small enough for the exact test."""
    c, n = si.table(s, d, "customer"), si.table(s, d, "nation")
    per = (n.join(c, c.c_nationkey == n.n_nationkey, "left").groupBy("n_nationkey", "n_regionkey")
           .agg(F.round(F.coalesce(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), F.lit(0)) + F.col("n_nationkey"), 2).alias("x")))
    cohort = per.select(F.col("n_nationkey").cast("string").alias("id"), F.col("x").cast("string").alias("balance"))
    ids = n.where("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("id"))
    vc = _vc(s, d, cohort, ["balance"], ids)
    t = st.ranksum_stats(vc).join(st.welch_stats(vc), "covariate", "full").withColumn("kind", F.lit("numeric"))
    return t.select("covariate", "rs_n1", "rs_n2", "rs_r1").join(
        st.p_values(t).select("covariate", F.round("p", 9).alias("p"), "test"), "covariate")


def _kind_warnings(s, d):
    mixed = si.table(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), "c_mktsegment", si.txt("c_acctbal").alias("c_acctbal"),
        F.when(F.col("c_custkey") % 2 == 0, si.txt("c_acctbal")).otherwise(F.col("c_mktsegment")).alias("mixed"))
    return st.kind_warnings(st.value_counts_long(mixed, ["c_mktsegment", "c_acctbal", "mixed"]))


def _status_by_order(s, d):
    """Status records with neither a date nor a numeric age: the first record of each subject."""
    sc = si.survival_characteristic(s, d).drop("created_datetime").withColumn("age_at_lkss", F.lit("unknown"))
    return sv.last_known_status(sc)[0].select("id", "dst_id", "lkss", "age_at_lkss")


def _ids_from_file(s, d):
    """The id list written as an uploaded file, one id per line with blanks around, and read back with its label."""
    path = shared_path(s, f"{REGION_LABEL}.txt")
    ids = si.region_ids(s, d)
    lines = ids.select(F.concat(F.lit("  "), "id", F.lit("\t"))).unionAll(ids.select("id")).unionAll(ids.select(F.lit(" ")).distinct())
    lines.write.text(path)
    read, label = subject_id_upload(s, path)
    return read.withColumn("label", F.lit(label))


def _report_from_file(s, d):
    """The labels report written as csv and read back."""
    path = shared_path(s, "report")
    write_report(_t1_labels(s, d, with_p=False).drop("P_value"), path)
    return s.read.option("header", True).option("nullValue", "NULL").schema(
        f"ord int, Covariate string, `{LANG_LABEL}` string, `Everything else` string").csv(path)


def entity_pairs(s, d, column):
    """``column`` of the person frame for every subject of the merged-with-lineitem table."""
    parts = merge_parts(s, d)
    return subject_pairs(parts.subject, parts.person, column, via="dst_id", on="id")


def customer_subjects(s, d):
    return si.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))


def customer_pairs(s, d):
    """Covariate pairs of the customer cohort read from each source frame (no fan-out)."""
    c = si.table(s, d, "customer")
    n = si.table(s, d, "nation").select("n_nationkey", "n_name")
    cust = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("id"), si.txt("c_acctbal").alias("c_acctbal"),
        "c_mktsegment", F.col("n_name").alias("nation"))
    subj = customer_subjects(s, d)
    orders = si.table(s, d, "orders").select(
        F.col("o_custkey").cast("string").alias("dst_id"), "o_orderpriority", "o_orderstatus",
        si.txt("o_totalprice").alias("o_totalprice"))
    return union_pairs([subject_pairs(subj, cust, ["c_acctbal", "c_mktsegment", "nation"], via="id", on="id"),
                        subject_pairs(subj, orders, ["o_orderpriority", "o_orderstatus", "o_totalprice"])])


def _t1_labels(s, d, with_p=True):
    return table1(si.labels_cohort(s, d), LABEL_COVARIATES, si.language_ids(s, d), LANG_LABEL, with_p=with_p, with_test=with_p)


def _vc(s, d, cohort, cols, ids):
    return st.value_counts_long(cohort, cols, ids)


def _ranksum(s, d, col):
    vc = _vc(s, d, si.customer_cohort(s, d), [col], si.region_ids(s, d))
    r = st.ranksum_stats(vc)
    return r.select("covariate", "rs_n1", "rs_n2", F.round("rs_r1", 6).alias("rs_r1"),
                    F.round("rs_ties", 6).alias("rs_ties"), "rs_has_ties")


def _welch(s, d, col):
    w = st.welch_stats(_vc(s, d, si.customer_cohort(s, d), [col], si.region_ids(s, d)))
    return w.select("covariate", "w_n1", F.round("w_m1", 6).alias("w_m1"), F.round("w_v1", 3).alias("w_v1"),
                    "w_n2", F.round("w_m2", 6).alias("w_m2"), F.round("w_v2", 3).alias("w_v2"))


def _contingency(cohort, col, ids, p=None):
    """Test inputs; ``p='pearson'`` adds the asymptotic Pearson p (df = levels - 1),
    ``p='fisher'`` the Fisher exact p of the 2x2 table, whatever test the selector picks."""
    t = st.contingency_tests(st.contingency(st.value_counts_long(cohort, [col], ids)))
    extra = []
    if p == "pearson":
        extra = [F.round(st.chisq_p_udf(F.col("stat"), F.greatest(F.col("r") - 1, F.lit(1))), 9).alias("p_pearson")]
    elif p == "fisher":
        extra = [F.round(st.fisher_p_udf("a", "b", "c", "d"), 9).alias("p_fisher")]
    return t.select("covariate", "r", "N", "C1", "C2", "min_cell", "test", F.round("stat", 9).alias("stat"),
                    "df", "a", "b", "c", "d", *extra)


def _monte_carlo(s, d, col):
    ct = materialize(st.contingency(st.value_counts_long(si.customer_cohort(s, d), [col], si.region_ids(s, d))))
    tests = st.contingency_tests(ct)
    return monte_carlo_p(ct, tests).select("covariate", F.round("p_mc", 9).alias("p_mc"))


def _monte_carlo_agrees(s, d, col):
    """Simulated against asymptotic p of a table, whatever test the selector picks: within three
    standard errors, plus the asymptotic error of one over the smallest expected cell."""
    ct = materialize(st.contingency(st.value_counts_long(si.customer_cohort(s, d), [col], si.region_ids(s, d))))
    tests = materialize(st.contingency_tests(ct).withColumn("test", F.lit("chisq_mc")))
    p = st.chisq_p_udf(F.col("stat"), F.greatest(F.col("r") - 1, F.lit(1)))
    j = tests.withColumn("p", p).join(monte_carlo_p(ct, tests), "covariate")
    error = 3 * F.sqrt(F.col("p") * (1 - F.col("p")) / DEFAULT_REPLICATES)
    least = F.least("C1", "C2") / F.col("r")
    return j.select("covariate", F.round("p", 9).alias("p_asymptotic"),
                    (F.abs(F.col("p_mc") - F.col("p")) <= error + 0.3 / least).alias("agrees"))


def _p_numeric(s, d, col):
    vc = _vc(s, d, si.customer_cohort(s, d), [col], si.region_ids(s, d))
    t = st.ranksum_stats(vc).join(st.welch_stats(vc), "covariate", "full").withColumn("kind", F.lit("numeric"))
    return st.p_values(t).select("covariate", F.round("p", 9).alias("p"))


TABLE1 = {
    "table1_customers_two_group": lambda s, d: _t1_customers(s, d),
    "table1_customers_counts": lambda s, d: _t1_customers(s, d, with_p=False).drop("P_value"),
    "table1_customers_single": lambda s, d: _t1_customers(s, d, two=False),
    "table1_customers_counts_from_pairs": lambda s, d: table1(
        customer_subjects(s, d), CUSTOMER_COVARIATES, si.region_ids(s, d), REGION_LABEL, with_p=False,
        pairs=customer_pairs(s, d)).drop("P_value"),
    "table1_labels_two_group": lambda s, d: _t1_labels(s, d),
    "table1_labels_counts": lambda s, d: _t1_labels(s, d, with_p=False).drop("P_value"),
    "ranksum_acctbal": lambda s, d: _ranksum(s, d, "c_acctbal"),
    "ranksum_totalprice_fanout": lambda s, d: _ranksum(s, d, "o_totalprice"),
    "welch_acctbal": lambda s, d: _welch(s, d, "c_acctbal"),
    "ranksum_p_acctbal": lambda s, d: _p_numeric(s, d, "c_acctbal"),
    "ranksum_p_totalprice_fanout": lambda s, d: _p_numeric(s, d, "o_totalprice"),
    "chisq_segment": lambda s, d: _contingency(si.customer_cohort(s, d), "c_mktsegment", si.region_ids(s, d),
                                               p="pearson"),
    "chisq_priority_fanout": lambda s, d: _contingency(si.customer_cohort(s, d), "o_orderpriority",
                                                       si.region_ids(s, d)),
    "contingency_nation_sparse": lambda s, d: _contingency(si.customer_cohort(s, d), "nation", si.region_ids(s, d)),
    "chisq_monte_carlo_segment": lambda s, d: _monte_carlo_agrees(s, d, "c_mktsegment"),
    "chisq_monte_carlo_priority_fanout": lambda s, d: _monte_carlo_agrees(s, d, "o_orderpriority"),
    "chisq_monte_carlo_nation": lambda s, d: _monte_carlo(s, d, "nation"),
    "fisher_toxicity": lambda s, d: _contingency(si.labels_cohort(s, d), "toxicity", si.language_ids(s, d),
                                                 p="fisher"),
}
TABLE1["distribution_segment_from_pairs"] = lambda s, d: r9(ds.percentage_distribution(
    None, "c_mktsegment", pairs=entity_pairs(s, d, "c_mktsegment")))
TABLE1.update({
    "pearson_quality": lambda s, d: _contingency(si.labels_cohort(s, d), "quality_label", si.language_ids(s, d), p="pearson"),
    "table1_constant_covariates": _t1_constant,
    "ranksum_exact_nation_balance": _exact_ranksum,
    "covariate_kind_warnings": _kind_warnings,
    "status_by_order": _status_by_order,
    "distribution_plot_order": lambda s, d: r9(ds.plot_order(ds.percentage_distribution(merged(s, d), "o_orderpriority"))),
    "uploaded_ids_from_file": _ids_from_file,
    "table1_labels_report_file": _report_from_file,
})
QUERIES.update(TABLE1)


def _latest_order(s, d):
    o = si.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return latest_per_key(o, "o_custkey", "o_orderdate", "o_orderkey")


def _first_line(s, d):
    li = si.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return first_per_key(li, "l_orderkey", "l_linenumber")


SLICES_GROUPS = {
    "latest_order_per_customer": _latest_order,
    "first_line_per_order": _first_line,
    "group_counts_region_ids": lambda s, d: group_counts(si.customer_cohort(s, d), si.region_ids(s, d)),
    "covariate_kinds_customers": lambda s, d: st.covariate_kinds(
        st.value_counts_long(si.customer_cohort(s, d), [c.column for c in CUSTOMER_COVARIATES])),
}
QUERIES.update(SLICES_GROUPS)
