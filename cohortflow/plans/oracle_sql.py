"""ANSI SQL (DuckDB dialect) for the same results, used as an independent check.

Each builder returns SQL text over the driver's table views. The SQL is written
from the definitions, not generated from the Spark plan, so a shared mistake in
the DataFrame code does not hide.
"""

from __future__ import annotations

Z975 = "1.959963984540054"


def round_r(x: str, d: int = 2) -> str:
    """Half-to-even on decimal candidates (same float steps as the Spark expression)."""
    p = f"{float(10 ** d)!r}"
    ax = f"abs({x})"
    x10 = f"({ax} * {p})"
    xd = f"(floor({x10}) / {p})"
    xu = f"(ceil({x10}) / {p})"
    du = f"({xu} - {ax})"
    dd = f"({ax} - {xd})"
    r = (f"(CASE WHEN {du} < {dd} OR ({du} = {dd} AND CAST(floor({x10}) AS BIGINT) % 2 = 1) "
         f"THEN {xu} ELSE {xd} END)")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN -{r} ELSE {r} END + 0.0)"


def fmt_num(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x} + 0.0), '\\.?0+$', '')"


def n_pct(n: str, d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL OR {d} = 0 THEN '0 (0%)' ELSE "
            f"CAST(CAST({n} AS BIGINT) AS VARCHAR) || ' (' || {fmt_num(round_r(f'100.0 * {n} / {d}'))} || '%)' END)")


def r9(x: str) -> str:
    return f"round({x}, 9)"


# ---------------------------------------------------------------- stand-in entities
TIMING = """timing AS (
  SELECT o_orderkey AS id, o_custkey AS dst_id,
         CASE WHEN o_orderstatus = 'F' THEN 'Initial Diagnosis' ELSE o_orderstatus END AS disease_phase,
         datediff('day', DATE '1990-01-01', o_orderdate) AS age_at_disease_phase,
         o_orderdate AS created_datetime
  FROM orders)"""

DIAG = """diag AS (
  SELECT dst_id, age_at_disease_phase FROM (
    SELECT *, row_number() OVER (PARTITION BY dst_id ORDER BY created_datetime DESC NULLS LAST, id) AS rn
    FROM timing WHERE disease_phase = 'Initial Diagnosis') WHERE rn = 1)"""

SURV_CHAR = """sc AS (
  SELECT o_orderkey AS id, o_custkey AS dst_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Dead' ELSE 'Alive' END AS lkss,
         datediff('day', DATE '1990-01-01', o_orderdate) AS age_at_lkss,
         o_orderdate AS created_datetime
  FROM orders),
lks AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dst_id ORDER BY created_datetime DESC NULLS LAST, id) AS rn
    FROM sc) WHERE rn = 1)"""

OS = f"""WITH {TIMING},
{DIAG},
{SURV_CHAR},
os AS (
  SELECT * FROM (
    SELECT s.dst_id AS subject_id,
           (CAST(s.age_at_lkss AS DOUBLE) - CAST(d.age_at_disease_phase AS DOUBLE)) / 365.25 AS time_years,
           CASE WHEN s.lkss IS NULL THEN NULL WHEN lower(s.lkss) = 'dead' THEN 1 ELSE 0 END AS event
    FROM lks s JOIN diag d ON s.dst_id IS NOT DISTINCT FROM d.dst_id)
  WHERE time_years IS NOT NULL AND event IS NOT NULL AND time_years >= 0)"""

EFS = f"""WITH {TIMING},
{DIAG},
subj AS (
  SELECT * FROM (
    SELECT o_custkey AS id,
           CASE WHEN o_orderpriority = '2-HIGH' THEN 'Subject has had one or more events'
                ELSE 'Subject has not had an event' END AS censor_status,
           datediff('day', DATE '1990-01-01', o_orderdate) AS age_at_censor_status,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn
    FROM orders) WHERE rn = 1),
efs AS (
  SELECT * FROM (
    SELECT s.id AS subject_id,
           (CAST(s.age_at_censor_status AS DOUBLE) - CAST(d.age_at_disease_phase AS DOUBLE)) / 365.25 AS time_years,
           CASE WHEN s.censor_status IS NULL THEN NULL
                WHEN s.censor_status = 'Subject has had one or more events' THEN 1 ELSE 0 END AS event
    FROM subj s JOIN diag d ON s.id IS NOT DISTINCT FROM d.dst_id)
  WHERE time_years IS NOT NULL AND event IS NOT NULL AND time_years >= 0)"""

SHIP = """WITH ship AS (
  SELECT * FROM (
    SELECT datediff('day', o_orderdate, l_shipdate) / 365.25 AS time_years,
           CAST(l_returnflag = 'R' AS INTEGER) AS event
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE time_years IS NOT NULL AND event IS NOT NULL AND time_years >= 0)"""

REGION_IDS = """ids AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer
  WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))"""


def km_ctes(base: str, by: str | None = None) -> str:
    """CTEs ``km_agg, km_run, km`` over ``base(time_years, event[, by])``."""
    pk = f"PARTITION BY {by} " if by else ""
    sel_by = f"{by}, " if by else ""
    return f"""km_agg AS (
  SELECT {sel_by}CAST(time_years AS DOUBLE) AS time, CAST(sum(event) AS BIGINT) AS n_event,
         count(*) AS n_obs
  FROM {base} GROUP BY ALL),
km_run AS (
  SELECT *, sum(n_obs) OVER ({pk}) - sum(n_obs) OVER ({pk}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            + n_obs AS n_risk
  FROM km_agg),
km_w AS (
  SELECT *,
    product(1.0 - CAST(n_event AS DOUBLE) / n_risk) OVER w AS surv0,
    sum(CASE WHEN n_risk > n_event THEN CAST(n_event AS DOUBLE) / (CAST(n_risk AS DOUBLE) * (n_risk - n_event))
             ELSE 0.0 END) OVER w AS gw,
    sum(CASE WHEN n_risk = n_event AND n_event > 0 THEN 1 ELSE 0 END) OVER w AS all_dead
  FROM km_run WINDOW w AS ({pk}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
km AS (
  SELECT {sel_by}time, CAST(n_risk AS BIGINT) AS n_risk, n_event, n_obs - n_event AS n_censor,
    CASE WHEN all_dead > 0 THEN CAST(0 AS DOUBLE) ELSE surv0 END AS surv,
    CASE WHEN all_dead = 0 THEN sqrt(gw) END AS std_err,
    CASE WHEN all_dead = 0 AND surv0 > 0 THEN exp(ln(surv0) - {Z975} * sqrt(gw)) END AS lower,
    CASE WHEN all_dead = 0 AND surv0 > 0 THEN least(exp(ln(surv0) + {Z975} * sqrt(gw)), 1.0) END AS upper
  FROM km_w)"""


def km_select(by: str | None = None) -> str:
    sel_by = f"{by}, " if by else ""
    return (f"SELECT {sel_by}{r9('time')} AS time, n_risk, n_event, n_censor, {r9('surv')} AS surv, "
            f"{r9('std_err')} AS std_err, {r9('lower')} AS lower, {r9('upper')} AS upper FROM km")


# ---------------------------------------------------------------- flattened entities
def g15(x: str) -> str:
    return f"printf('%.15g', {x})"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


FLAT_PERSON = f"""SELECT CAST(c_custkey AS VARCHAR) AS id, 'person' AS name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, {g15('c_acctbal')} AS c_acctbal, c_mktsegment,
  c_name AS person_name, CAST(c_nationkey AS VARCHAR) AS dst_id, 'nation' AS dst_name
FROM customer"""

FLAT_SUBJECT = f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'subject' AS name, o_orderstatus,
  {g15('o_totalprice')} AS o_totalprice, {ts('o_orderdate')} AS o_orderdate, o_orderpriority,
  o_orderstatus AS state, CAST(o_custkey AS VARCHAR) AS dst_id, 'person' AS dst_name
FROM orders"""

FLAT_LINEITEM = f"""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
  'lineitem' AS name, CAST(l_linenumber AS VARCHAR) AS l_linenumber, {g15('l_quantity')} AS l_quantity,
  {g15('l_extendedprice')} AS l_extendedprice, {g15('l_discount')} AS l_discount, l_returnflag,
  {ts('l_shipdate')} AS l_shipdate, l_returnflag || ';' || l_linestatus AS flags,
  CAST(l_orderkey AS VARCHAR) AS dst_id, 'subject' AS dst_name
FROM lineitem"""

MERGED = f"""WITH s AS ({FLAT_SUBJECT}), p AS ({FLAT_PERSON}),
merged AS (
  SELECT s.id, s.name AS name_subject, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority,
         s.state, s.dst_id, s.dst_name AS dst_name_subject,
         p.name AS name_person, p.c_nationkey, p.c_acctbal, p.c_mktsegment, p.person_name,
         p.dst_id AS dst_id_person, p.dst_name AS dst_name_person
  FROM s LEFT JOIN p ON s.dst_id IS NOT DISTINCT FROM p.id)"""

MERGED_LI = f"""{MERGED}, l AS ({FLAT_LINEITEM}),
merged_li AS (
  SELECT m.*, l.id AS id_lineitem, l.name, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_returnflag, l.l_shipdate, l.flags, l.dst_name
  FROM merged m LEFT JOIN l ON m.id IS NOT DISTINCT FROM l.dst_id)"""

MERGED_LI_COLUMNS = ["name_subject", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "state",
                     "name_person", "c_nationkey", "c_acctbal", "c_mktsegment", "person_name", "name",
                     "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                     "l_shipdate", "flags"]

ENTITY_NAMES = """names AS (
  SELECT 'person' AS name FROM customer UNION ALL SELECT 'subject' FROM orders
  UNION ALL SELECT 'lineitem' FROM lineitem)"""


def column_types_sql() -> str:
    parts = [f"""SELECT '{c}' AS "column", count(TRY_CAST({c} AS DOUBLE)) AS n_numeric,
  CAST(count_if({c} IS NULL OR {c} <> '') AS BIGINT) AS n_nonempty FROM merged_li""" for c in MERGED_LI_COLUMNS]
    body = "\nUNION ALL\n".join(parts)
    return f"""{MERGED_LI}, ct AS ({body})
SELECT "column", n_numeric, n_nonempty, round(n_numeric / greatest(1, n_nonempty), 9) AS numeric_share,
       n_numeric / greatest(1, n_nonempty) >= 0.9 AS is_numeric FROM ct"""


def distribution_sql(source_ctes: str, source: str, col: str, id_col: str = "id", export: bool = False) -> str:
    pctx = round_r(f"100.0 * n / (SELECT sum(n) FROM vc)")
    body = f"""{source_ctes}, vc AS (
  SELECT {col}, count(*) AS n FROM (SELECT DISTINCT {id_col}, {col} FROM {source}) GROUP BY {col})"""
    if export:
        return f"{body} SELECT coalesce({col}, 'N/A') AS {col}, round({pctx}, 9) AS Percentage FROM vc"
    return (f"{body} SELECT {col}, n, round({pctx}, 9) AS Percentage, "
            f"{fmt_num(pctx)} || '%' AS Label FROM vc")


def flatten_oracles() -> dict[str, str]:
    return {
        "entity_types": f"WITH {ENTITY_NAMES} SELECT DISTINCT name FROM names",
        "optional_entities": f"""WITH {ENTITY_NAMES} SELECT DISTINCT name FROM names
WHERE name NOT IN ('subject', 'person', 'timing', 'survival_characteristic', 'Metadata', 'program', 'project')""",
        "flatten_summary": f"WITH {ENTITY_NAMES} SELECT name, count(*) AS n_records FROM names GROUP BY name",
        "flatten_person": FLAT_PERSON,
        "flatten_subject": FLAT_SUBJECT,
        "flatten_lineitem": FLAT_LINEITEM,
        "flatten_json_person": FLAT_PERSON,
        "flatten_json_subject": FLAT_SUBJECT,
        "flatten_json_lineitem": FLAT_LINEITEM,
        "merge_subject_person": f"{MERGED} SELECT * FROM merged",
        "merge_with_lineitem": f"{MERGED_LI} SELECT * FROM merged_li",
        "merge_with_lineitem_staged": f"{MERGED_LI} SELECT * FROM merged_li",
        "dataset_shape": f"{MERGED_LI} SELECT count(*) AS n_rows, 26 AS n_columns FROM merged_li",
        "column_types": column_types_sql(),
    }


def distribution_oracles() -> dict[str, str]:
    return {
        "distribution_priority": distribution_sql(MERGED, "merged", "o_orderpriority"),
        "distribution_segment_fanout": distribution_sql(MERGED_LI, "merged_li", "c_mktsegment"),
        # same result, computed by the Spark side from person pairs without the merged table
        "distribution_segment_from_pairs": distribution_sql(MERGED_LI, "merged_li", "c_mktsegment"),
        "distribution_returnflag_export": distribution_sql(MERGED_LI, "merged_li", "l_returnflag", export=True),
        "covariate_values_segment": f"{MERGED} SELECT DISTINCT c_mktsegment FROM merged WHERE c_mktsegment IS NOT NULL",
        "covariate_kind": f"""{MERGED_LI}
SELECT 'l_quantity' AS "column", coalesce(max(TRY_CAST(l_quantity AS DOUBLE) IS NOT NULL), false) AS numeric FROM merged_li
UNION ALL
SELECT 'c_mktsegment', coalesce(max(TRY_CAST(c_mktsegment AS DOUBLE) IS NOT NULL), false) FROM merged_li""",
    }


def survival_oracles(risk_breaks) -> dict[str, str]:
    os_grouped = f"""{OS},
{REGION_IDS},
osg AS (
  SELECT subject_id, time_years, event,
         CASE WHEN subject_id IN (SELECT CAST(id AS BIGINT) FROM ids) THEN 'G1' ELSE 'G2' END AS grp
  FROM os)"""
    median_cols = """km_med AS (
  SELECT {by}min(CASE WHEN surv <= 0.5 + 1.49e-8 THEN time END) AS t_half,
         max(CASE WHEN surv <= 0.5 + 1.49e-8 THEN surv END) AS s_half,
         min(CASE WHEN surv < 0.5 - 1.49e-8 THEN time END) AS t_below
  FROM km {grp})
SELECT {by}round(CASE WHEN t_half IS NULL THEN NULL
                 WHEN abs(s_half - 0.5) < 1.49e-8 AND t_below IS NOT NULL THEN (t_half + t_below) / 2
                 ELSE t_half END, 9) AS median FROM km_med"""
    breaks = ", ".join(f"({i}, {b!r})" for i, b in enumerate(risk_breaks))
    return {
        "overall_survival": f"{OS} SELECT subject_id, {r9('time_years')} AS time_years, event FROM os",
        "event_free_survival": f"{EFS} SELECT subject_id, {r9('time_years')} AS time_years, event FROM efs",
        "overall_survival_text_dates": f"{OS} SELECT subject_id, {r9('time_years')} AS time_years, event FROM os",
        "overall_survival_without_dates":
            OS.replace("ORDER BY created_datetime DESC NULLS LAST, id) AS rn\n    FROM timing",
                       "ORDER BY age_at_disease_phase DESC NULLS LAST, id) AS rn\n    FROM timing")
            .replace("ORDER BY created_datetime DESC NULLS LAST, id) AS rn\n    FROM sc",
                     "ORDER BY age_at_lkss DESC NULLS LAST, id) AS rn\n    FROM sc")
            + f" SELECT subject_id, {r9('time_years')} AS time_years, event FROM os",
        "event_free_survival_without_dates":
            EFS.replace("ORDER BY o_orderdate DESC NULLS LAST, o_orderkey", "ORDER BY o_orderkey")
            + f" SELECT subject_id, {r9('time_years')} AS time_years, event FROM efs",
        "km_efs_uploaded_ids": f"""{EFS},
{REGION_IDS},
sub AS (SELECT * FROM efs WHERE subject_id IN (SELECT CAST(id AS BIGINT) FROM ids)),
{km_ctes('sub')} {km_select()}""",
        "km_overall_survival": f"{OS}, {km_ctes('os')} {km_select()}",
        "km_event_free_survival": f"{EFS}, {km_ctes('efs')} {km_select()}",
        "km_ship_delay": f"{SHIP}, {km_ctes('ship')} {km_select()}",
        "km_os_uploaded_ids": f"""{OS},
{REGION_IDS},
sub AS (SELECT * FROM os WHERE subject_id IN (SELECT CAST(id AS BIGINT) FROM ids)),
{km_ctes('sub')} {km_select()}""",
        "km_os_by_group": f"{os_grouped}, {km_ctes('osg', 'grp')} {km_select('grp')}",
        "km_median_os": f"{os_grouped}, {km_ctes('osg', 'grp')}, "
                        + median_cols.format(by="grp, ", grp="GROUP BY grp"),
        "km_median_ship_delay": f"{SHIP}, {km_ctes('ship')}, " + median_cols.format(by="", grp=""),
        "km_risk_table_os": f"""{OS},
brk(i, time) AS (VALUES {breaks})
SELECT round(CAST(time AS DOUBLE), 9) AS time, CAST((SELECT count(*) FROM os WHERE os.time_years >= brk.time) AS BIGINT) AS n_risk
FROM brk""",
        "km_curve_os": f"""{OS}, {km_ctes('os')}
SELECT CAST(0 AS DOUBLE) AS time, CAST(1 AS DOUBLE) AS surv, CAST(1 AS DOUBLE) AS lower,
       CAST(1 AS DOUBLE) AS upper, false AS censored
UNION ALL
SELECT {r9('time')}, {r9('surv')}, {r9('lower')}, {r9('upper')}, n_censor > 0 FROM km""",
    }


# ---------------------------------------------------------------- Table 1 and tests
CUSTOMER_COHORT = f"""cust AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, {g15('c_acctbal')} AS c_acctbal, c_mktsegment, n_name AS nation
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
ordr AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id_orders, CAST(o_custkey AS VARCHAR) AS dst_id, o_orderpriority,
         o_orderstatus, {g15('o_totalprice')} AS o_totalprice FROM orders),
cohort AS (
  SELECT cust.*, ordr.id_orders, ordr.o_orderpriority, ordr.o_orderstatus, ordr.o_totalprice
  FROM cust LEFT JOIN ordr ON cust.id IS NOT DISTINCT FROM ordr.dst_id)"""

LABELS_COHORT = """cohort AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS quality_label,
         CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS toxicity FROM labels),
ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'es')"""


def sql_str(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _pairs_ctes(covs, two: bool) -> str:
    pairs = "\n  UNION ALL ".join(f"SELECT DISTINCT id, '{c}' AS covariate, CAST({c} AS VARCHAR) AS value FROM cohort"
                                  for c, _, _ in covs)
    grp = ("CASE WHEN id IN (SELECT id FROM ids) THEN 'G1' ELSE 'G2' END" if two else "'ALL'")
    return f"""subj AS (SELECT DISTINCT id, {grp} AS grp FROM cohort),
pairs AS ({pairs}),
pg AS (SELECT p.covariate, p.value, TRY_CAST(p.value AS DOUBLE) AS x, s.grp
       FROM pairs p JOIN subj s ON p.id IS NOT DISTINCT FROM s.id)"""


def table1_sql(base_ctes: str, covs, g1_label: str | None, two: bool) -> str:
    """Table 1 cells (no p-values). ``covs``: (column, 'numeric'|'categorical', values)."""
    groups = [("G1", g1_label), ("G2", "Everything else")] if two else [("ALL", "Everything")]

    def cells(expr_for_grp):
        return ", ".join(f'({expr_for_grp(g)}) AS "{label}"' for g, label in groups)

    rows = [f"""SELECT 0 AS ord, 'Count' AS Covariate, {cells(lambda g: f"SELECT CAST(count(*) AS VARCHAR) || ' (Count)' FROM subj WHERE grp = '{g}'")}"""]
    for k, (c, kind, values) in enumerate(covs, start=1):
        base = k * 1000
        w = f"FROM pg WHERE covariate = '{c}' AND grp = '{{g}}'"
        rows.append(f"SELECT {base}, {sql_str(c)}, {cells(lambda g: sql_str(''))}")
        if kind == "numeric":
            if "Mean" in values:
                rows.append(f"SELECT {base + 1}, '   Mean', " + cells(
                    lambda g: f"SELECT {fmt_num(round_r('avg(x)'))} {w.format(g=g)} AND x IS NOT NULL"))
            if "Mode" in values:
                rows.append(f"SELECT {base + 2}, '   Mode', " + cells(
                    lambda g: f"SELECT {g15('x')} FROM (SELECT x, count(*) AS n {w.format(g=g)} AND x IS NOT NULL "
                              f"GROUP BY x) ORDER BY n DESC, x LIMIT 1"))
            rows.append(f"SELECT {base + 999}, '   Missing', " + cells(
                lambda g: f"SELECT {n_pct('count_if(x IS NULL)', 'count(*)')} {w.format(g=g)}"))
        else:
            nonmissing = "count_if(value IS NOT NULL AND value <> '')"
            for i, lvl in enumerate(values):
                hit = f"count_if(value = {sql_str(lvl)})"
                rows.append(f"SELECT {base + 1 + i}, {sql_str('   ' + lvl)}, " + cells(
                    lambda g, hit=hit: f"SELECT {n_pct(hit, nonmissing)} {w.format(g=g)}"))
            missing = "count_if(value IS NULL OR value IN ('None', ''))"
            rows.append(f"SELECT {base + 999}, '   Missing', " + cells(
                lambda g: f"SELECT {n_pct(missing, 'count(*)')} {w.format(g=g)}"))
    body = "\nUNION ALL\n".join(rows)
    return f"WITH {base_ctes},\n{_pairs_ctes(covs, two)}\n{body}"


def _numeric_pg(base_ctes: str, col: str) -> str:
    return f"""WITH {base_ctes},
{_pairs_ctes([(col, 'numeric', [])], True)},
nv AS (SELECT x, CAST(count_if(grp = 'G1') AS BIGINT) AS c1, CAST(count_if(grp = 'G2') AS BIGINT) AS c2
        FROM pg WHERE x IS NOT NULL GROUP BY x)"""


def ranksum_sql(base_ctes: str, col: str) -> str:
    return f"""{_numeric_pg(base_ctes, col)},
rk AS (SELECT *, c1 + c2 AS c, sum(c1 + c2) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM nv)
SELECT '{col}' AS covariate, CAST(sum(c1) AS BIGINT) AS rs_n1, CAST(sum(c2) AS BIGINT) AS rs_n2,
       round(sum(c1 * (cum - c + (c + 1) / 2.0)), 6) AS rs_r1,
       round(sum(CAST(c AS DOUBLE) * c * c - c), 6) AS rs_ties, max(c > 1) AS rs_has_ties FROM rk"""


def two_sided_sql(z: str) -> str:
    """P(|Z| >= |z|) by the series of the normal integral (terms by lgamma), good to 1e-12 for |z| < 6."""
    terms = (f"(SELECT sum(exp((2 * k + 1) * ln(abs({z}) + 1e-300) "
             f"- lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1))) FROM range(0, 120) t(k))")
    return f"(1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms})"


def chisq_tail_sql(x: str, df: str) -> str:
    """Upper chi-square tail by the power series of the incomplete gamma function."""
    return (f"(1 - (SELECT sum(exp(({df} / 2.0 + k) * ln({x} / 2.0 + 1e-300) - {x} / 2.0 "
            f"- lgamma({df} / 2.0 + k + 1))) FROM range(0, 600) t(k)))")


def ranksum_p_sql(base_ctes: str, col: str) -> str:
    """Rank-sum p with tie and continuity correction (groups too large for the exact test)."""
    return f"""WITH inputs AS ({ranksum_sql(base_ctes, col)}),
m AS (SELECT covariate, rs_r1 - rs_n1 * (rs_n1 + 1) / 2.0 - rs_n1 * rs_n2 / 2.0 AS d,
             sqrt((rs_n1 * rs_n2 / 12.0) * ((rs_n1 + rs_n2 + 1)
                  - rs_ties / (CAST(rs_n1 + rs_n2 AS DOUBLE) * (rs_n1 + rs_n2 - 1)))) AS sigma FROM inputs),
z AS (SELECT covariate, (d - 0.5 * sign(d)) / sigma AS z FROM m)
SELECT covariate, round({two_sided_sql("z")}, 9) AS p FROM z"""


def simulated_p_sql(base_ctes: str, col: str) -> str:
    """Asymptotic p, and that the simulated p agrees with it."""
    return f"""WITH c AS ({contingency_sql(base_ctes, col)})
SELECT covariate, round({chisq_tail_sql("stat", "(r - 1)")}, 9) AS p_asymptotic, true AS agrees FROM c"""


def welch_sql(base_ctes: str, col: str) -> str:
    return f"""WITH {base_ctes},
{_pairs_ctes([(col, 'numeric', [])], True)},
g AS (SELECT grp, count(*) AS cnt, avg(x) AS m, var_samp(x) AS v FROM pg WHERE x IS NOT NULL GROUP BY grp)
SELECT '{col}' AS covariate,
  (SELECT cnt FROM g WHERE grp = 'G1') AS w_n1, (SELECT round(m, 6) FROM g WHERE grp = 'G1') AS w_m1,
  (SELECT round(v, 3) FROM g WHERE grp = 'G1') AS w_v1,
  (SELECT cnt FROM g WHERE grp = 'G2') AS w_n2, (SELECT round(m, 6) FROM g WHERE grp = 'G2') AS w_m2,
  (SELECT round(v, 3) FROM g WHERE grp = 'G2') AS w_v2"""


def contingency_sql(base_ctes: str, col: str, p: str | None = None) -> str:
    """Test inputs of one categorical covariate; ``p``: 'chisq_df4' or 'fisher' adds a p-value column."""
    sql = f"""WITH {base_ctes},
{_pairs_ctes([(col, 'categorical', [])], True)},
ct AS (SELECT value AS level, CAST(count_if(grp = 'G1') AS BIGINT) AS n1, CAST(count_if(grp = 'G2') AS BIGINT) AS n2
       FROM pg WHERE value IS NOT NULL GROUP BY value),
tot AS (SELECT count(*) AS r, CAST(sum(n1) AS BIGINT) AS C1, CAST(sum(n2) AS BIGINT) AS C2, min(least(n1, n2)) AS min_cell,
               arg_min(n1, level) AS a, arg_min(n2, level) AS b, arg_max(n1, level) AS c, arg_max(n2, level) AS d
        FROM ct),
st AS (SELECT sum(CASE WHEN tot.r = 1 THEN (n1 - (C1 + C2) / 2.0) ^ 2 / ((C1 + C2) / 2.0) + (n2 - (C1 + C2) / 2.0) ^ 2 / ((C1 + C2) / 2.0)
                  ELSE (n1 - (n1 + n2) * C1 / (C1 + C2)) ^ 2 / ((n1 + n2) * C1 / (C1 + C2))
                     + (n2 - (n1 + n2) * C2 / (C1 + C2)) ^ 2 / ((n1 + n2) * C2 / (C1 + C2)) END) AS stat
       FROM ct, tot),
res AS (
  SELECT '{col}' AS covariate, r, C1 + C2 AS N, C1, C2, min_cell,
    CASE WHEN NOT (C1 > 0 AND C2 > 0) THEN NULL WHEN r = 2 AND min_cell < 5 THEN 'fisher'
         WHEN r = 2 THEN 'chisq' WHEN min_cell < 5 THEN 'chisq_mc' ELSE 'chisq' END AS test,
    stat, a, b, c, d FROM tot, st)"""
    cols = "covariate, r, N, C1, C2, min_cell, test, round(stat, 9) AS stat, " \
           "CAST(CASE WHEN test = 'chisq_mc' THEN NULL WHEN r = 1 THEN 1 ELSE r - 1 END AS INTEGER) AS df, a, b, c, d"
    if p == "chisq_df4":
        return f"{sql} SELECT {cols}, round(exp(-stat / 2) * (1 + stat / 2), 9) AS p_pearson FROM res"
    if p == "chisq_tail":
        return f"{sql} SELECT {cols}, round({chisq_tail_sql('stat', 'greatest(r - 1, 1)')}, 9) AS p_pearson FROM res"
    if p == "fisher":
        lg = "lgamma"
        return f"""{sql},
hyp AS (SELECT x, exp({lg}(a + c + 1) - {lg}(x + 1) - {lg}(a + c - x + 1) + {lg}(b + d + 1) - {lg}(a + b - x + 1)
                     - {lg}(b + d - a - b + x + 1) - {lg}(a + b + c + d + 1) + {lg}(a + b + 1) + {lg}(c + d + 1)) AS pr
        FROM res, range(CAST(greatest(0, a + b - (b + d)) AS BIGINT), CAST(least(a + b, a + c) + 1 AS BIGINT)) t(x))
SELECT {cols}, round(least(1.0, (SELECT sum(pr) FROM hyp WHERE pr <= (SELECT pr FROM hyp, res WHERE hyp.x = res.a) * (1 + 1e-7))), 9) AS p_fisher
FROM res"""
    return f"{sql} SELECT {cols} FROM res"


def fmt_p_sql(p: str) -> str:
    return f"CASE WHEN {p} IS NULL OR isnan({p}) THEN '—' WHEN {p} < 0.001 THEN '<0.001' ELSE printf('%.3f', {p}) END"


def report_p_sql(base_ctes: str, covs, g1_label: str) -> str:
    """Table 1 with p-values and their tests. A simulated p is told only where it must lie under 0.001: for statistics
    far beyond the degrees of freedom; elsewhere it is spelled 'simulated' and matches nothing."""
    parts = []
    for k, (c, kind, _) in enumerate(covs, start=1):
        if kind == "numeric":
            parts.append(f"SELECT {k * 1000} AS ord, {fmt_p_sql('p')} AS p, 'ranksum' AS test FROM ({ranksum_p_sql(base_ctes, c)})")
            continue
        fisher = "p_fisher" if kind == "binary" else "CAST(NULL AS DOUBLE)"
        table = contingency_sql(base_ctes, c, "fisher" if kind == "binary" else None)
        df = "greatest(r - 1, 1)"
        parts.append(f"""SELECT {k * 1000} AS ord, CASE test WHEN 'fisher' THEN {fmt_p_sql(fisher)}
  WHEN 'chisq_mc' THEN CASE WHEN stat > 10 * {df} + 60 THEN '<0.001' ELSE 'simulated' END
  ELSE {fmt_p_sql(f"CASE WHEN stat > 10 * {df} + 60 THEN 0.0 ELSE {chisq_tail_sql('stat', df)} END")} END AS p, test
FROM ({table})""")
    both = " UNION ALL ".join(parts)
    plain = [(c, "categorical" if kind == "binary" else kind, v) for c, kind, v in covs]
    return f"""WITH t AS ({table1_sql(base_ctes, plain, g1_label, True)}), pv AS ({both})
SELECT t.*, coalesce(pv.p, '') AS P_value, coalesce(pv.test, '') AS Test FROM t LEFT JOIN pv ON t.ord = pv.ord"""


CONSTANT_COHORT = f"""cohort AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal IS NOT NULL THEN 'yes' END AS one_level FROM customer),
{REGION_IDS}"""


def constant_report_sql(label: str) -> str:
    g = lambda x: f"""({x.format("WHERE id IN (SELECT id FROM ids)")}) AS "{label}", ({x.format("WHERE id NOT IN (SELECT id FROM ids)")}) AS "Everything else" """
    same = lambda x: f"{sql_str(x)}, {sql_str(x)}"
    n = "SELECT count(*) FROM cohort {}"
    yes = "SELECT " + n_pct("count_if(one_level = 'yes')", "count_if(one_level IS NOT NULL)") + " FROM cohort {}"
    miss = "SELECT " + n_pct("count_if(one_level IS NULL)", "count(*)") + " FROM cohort {}"
    none = "SELECT " + n_pct("0", "count(*)") + " FROM cohort {}"
    no = "SELECT " + n_pct("0", "count_if(one_level IS NOT NULL)") + " FROM cohort {}"
    count = n.replace("count(*)", "CAST(count(*) AS VARCHAR) || ' (Count)'")
    return f"""WITH {CONSTANT_COHORT},
c AS (SELECT count_if(id IN (SELECT id FROM ids)) AS a, count_if(id NOT IN (SELECT id FROM ids)) AS b FROM cohort WHERE one_level IS NOT NULL),
x AS (SELECT CAST((a - b) AS DOUBLE) ^ 2 / (a + b) AS stat FROM c)
SELECT 0 AS ord, 'Count' AS Covariate, {g(count)}, '' AS P_value, '' AS Test
UNION ALL SELECT 1000, 'constant', {same('')}, '—', 'welch'
UNION ALL SELECT 1001, '   Mean', {same('7')}, '', ''
UNION ALL SELECT 1002, '   Mode', {same('7')}, '', ''
UNION ALL SELECT 1003, '   Mean (SD)', {same('7 (0)')}, '', ''
UNION ALL SELECT 1999, '   Missing', {g(none)}, '', ''
UNION ALL SELECT 2000, 'one_level', {same('')}, {fmt_p_sql(f"CASE WHEN stat > 60 THEN 0.0 ELSE {chisq_tail_sql('stat', '1')} END")}, 'chisq' FROM x
UNION ALL SELECT 2001, '   yes', {g(yes)}, '', ''
UNION ALL SELECT 2002, '   no', {g(no)}, '', ''
UNION ALL SELECT 2999, '   Missing', {g(miss)}, '', ''"""


EXACT_RANKSUM = """WITH v AS (
  SELECT n_nationkey, n_regionkey = 0 AS one, row_number() OVER (ORDER BY x) AS rk FROM (
    SELECT n_nationkey, n_regionkey, coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) + n_nationkey AS x
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey)),
s AS (SELECT sum(rk) FILTER (one) AS r1, count_if(one) AS n1, count_if(NOT one) AS n2 FROM v),
draws AS (
  SELECT a.rk + b.rk + c.rk + d.rk + e.rk AS r FROM v a JOIN v b ON a.rk < b.rk JOIN v c ON b.rk < c.rk JOIN v d ON c.rk < d.rk
  JOIN v e ON d.rk < e.rk)
SELECT 'balance' AS covariate, CAST(n1 AS BIGINT) AS rs_n1, CAST(n2 AS BIGINT) AS rs_n2, CAST(r1 AS DOUBLE) AS rs_r1,
  round(least(1.0, 2.0 * least((SELECT count_if(r <= r1) FROM draws), (SELECT count_if(r >= r1) FROM draws)) / (SELECT count(*) FROM draws)), 9)
    AS p, 'ranksum' AS test
FROM s"""

KIND_WARNINGS = """WITH c AS (
  SELECT 'c_mktsegment' AS covariate, c_mktsegment AS value, false AS num FROM customer
  UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR), true FROM customer
  UNION ALL SELECT 'mixed', CAST(c_custkey AS VARCHAR), c_custkey % 2 = 0 FROM customer),
k AS (SELECT covariate, bool_or(num) AS card_numeric, count_if(num) / count(*) AS share FROM c WHERE value IS NOT NULL GROUP BY covariate)
SELECT covariate, card_numeric, share >= 0.9 AS table_numeric, CASE WHEN card_numeric AND share < 0.9 THEN
  'only ' || CAST(round(100 * share, 1) AS VARCHAR) || '% of the values are numbers: statistics count as levels' END AS warning FROM k"""


def table1_oracles(customer_covs, customer_kinds, label_covs, region_label, lang_label) -> dict[str, str]:
    cust_base = f"{CUSTOMER_COHORT},\n{REGION_IDS}"
    ccovs = [(c.column, customer_kinds.get(c.column, "categorical"), list(c.values)) for c in customer_covs]
    lcovs = [(c.column, "categorical", list(c.values)) for c in label_covs]
    return {
        "table1_customers_two_group": report_p_sql(cust_base, ccovs, region_label),
        "table1_labels_two_group": report_p_sql(LABELS_COHORT, [(c, "binary", v) for c, _, v in lcovs], lang_label),
        "table1_labels_report_file": table1_sql(LABELS_COHORT, lcovs, lang_label, True),
        "table1_constant_covariates": constant_report_sql(region_label),
        "pearson_quality": contingency_sql(LABELS_COHORT, "quality_label", p="chisq_tail"),
        "ranksum_exact_nation_balance": EXACT_RANKSUM,
        "covariate_kind_warnings": KIND_WARNINGS,
        "uploaded_ids_from_file": f"WITH {REGION_IDS} SELECT id, {sql_str(region_label)} AS label FROM ids",
        "status_by_order": """SELECT o_orderkey AS id, o_custkey AS dst_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Dead' ELSE 'Alive' END
  AS lkss, 'unknown' AS age_at_lkss FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
        "distribution_plot_order": f"""SELECT *, CAST(row_number() OVER (ORDER BY Percentage DESC, o_orderpriority NULLS LAST) AS INTEGER) AS rank
FROM ({distribution_sql(MERGED, "merged", "o_orderpriority")})""",
        "table1_customers_counts": table1_sql(cust_base, ccovs, region_label, True),
        # same result, computed by the Spark side from per-entity pairs instead of the merged table
        "table1_customers_counts_from_pairs": table1_sql(cust_base, ccovs, region_label, True),
        "table1_customers_single": table1_sql(CUSTOMER_COHORT, ccovs, None, False),
        "table1_labels_counts": table1_sql(LABELS_COHORT, lcovs, lang_label, True),
        "ranksum_acctbal": ranksum_sql(cust_base, "c_acctbal"),
        "ranksum_totalprice_fanout": ranksum_sql(cust_base, "o_totalprice"),
        "welch_acctbal": welch_sql(cust_base, "c_acctbal"),
        "ranksum_p_acctbal": ranksum_p_sql(cust_base, "c_acctbal"),
        "ranksum_p_totalprice_fanout": ranksum_p_sql(cust_base, "o_totalprice"),
        "chisq_monte_carlo_segment": simulated_p_sql(cust_base, "c_mktsegment"),
        "chisq_monte_carlo_priority_fanout": simulated_p_sql(cust_base, "o_orderpriority"),
        "chisq_segment": contingency_sql(cust_base, "c_mktsegment", p="chisq_df4"),
        "chisq_priority_fanout": contingency_sql(cust_base, "o_orderpriority"),
        "contingency_nation_sparse": contingency_sql(cust_base, "nation"),
        "fisher_toxicity": contingency_sql(LABELS_COHORT, "toxicity", p="fisher"),
    }


def slices_groups_oracles(customer_covs) -> dict[str, str]:
    covs = [(c.column, "categorical", []) for c in customer_covs]
    return {
        "latest_order_per_customer": """SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""",
        "first_line_per_order": """SELECT l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS rn
  FROM lineitem) WHERE rn = 1""",
        "group_counts_region_ids": f"""WITH {CUSTOMER_COHORT},
{REGION_IDS}
SELECT CASE WHEN id IN (SELECT id FROM ids) THEN 'G1' ELSE 'G2' END AS grp, count(*) AS n
FROM (SELECT DISTINCT id FROM cohort) GROUP BY 1""",
        "covariate_kinds_customers": f"""WITH {CUSTOMER_COHORT},
{_pairs_ctes(covs, False)}
SELECT covariate, CAST(count_if(value IS NOT NULL AND trim(value) <> '') AS BIGINT) AS n_nonblank,
       CAST(count_if(value IS NOT NULL AND trim(value) <> '' AND x IS NOT NULL) AS BIGINT) AS n_numeric,
       CASE WHEN count_if(value IS NOT NULL AND trim(value) <> '') = 0 THEN false
            ELSE count_if(value IS NOT NULL AND trim(value) <> '' AND x IS NOT NULL)
                 / count_if(value IS NOT NULL AND trim(value) <> '') >= 0.9 END AS is_numeric
FROM pg GROUP BY covariate""",
    }
