"""Report formatting as column expressions (Table 1 cells, labels, p-values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_r

# Report texts.
P_MISSING = "—"          # em dash for an unavailable p-value
P_SMALL = "<0.001"
ZERO_PCT = "0 (0%)"
COUNT_SUFFIX = " (Count)"
NA_LABEL = "N/A"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def fmt_num(c: Column | str, digits: int = 2) -> Column:
    """Print a number already rounded to ``digits`` without trailing zeros (``50.0`` -> ``50``)."""
    x = _col(c)
    s = F.format_string(f"%.{digits}f", x + F.lit(0.0))
    return F.regexp_replace(s, r"\.?0+$", "") if digits > 0 else s


def pct(n: Column | str, d: Column | str) -> Column:
    """R-rounded percentage ``100 n / d`` (2 decimals); NULL when d is 0 or NULL."""
    n, d = _col(n), _col(d)
    return F.when(d.isNotNull() & (d != 0), round_r(F.lit(100.0) * n / d, 2))


def n_pct(n: Column | str, d: Column | str) -> Column:
    """``"n (p%)"``; a zero or missing denominator gives ``"0 (0%)"``."""
    n, d = _col(n), _col(d)
    return (F.when(d.isNull() | (d == 0), F.lit(ZERO_PCT))
            .otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" ("),
                                fmt_num(pct(n, d)), F.lit("%)"))))


def fmt_p(p: Column | str) -> Column:
    p = _col(p)
    return (F.when(p.isNull() | F.isnan(p), F.lit(P_MISSING))
            .when(p < 0.001, F.lit(P_SMALL))
            .otherwise(F.format_string("%.3f", p)))


def pct_label(p: Column | str) -> Column:
    return F.concat(fmt_num(p), F.lit("%"))


def mean_sd(mean: Column | str, sd: Column | str) -> Column:
    """``"mean (sd)"`` with both rounded to 2; em dash when there is no value."""
    m, s = _col(mean), _col(sd)
    return F.when(m.isNull(), F.lit(P_MISSING)).otherwise(
        F.concat(fmt_num(round_r(m, 2)), F.lit(" ("), F.coalesce(fmt_num(round_r(s, 2)), F.lit("NA")), F.lit(")")))
