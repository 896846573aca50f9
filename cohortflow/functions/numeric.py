"""Numeric views of text values and R-compatible rounding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal literal as accepted by a lenient text->number conversion: optional
# sign, digits with optional fraction (or a bare fraction), optional exponent,
# or an infinity spelling; surrounding blanks allowed. "NaN" is deliberately
# not accepted: a NaN counts as missing downstream.
NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|([Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?))\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def to_num(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text -> double, NULL when not a number (never raises under ANSI mode).

    The regex guard matters: ``try_cast`` alone accepts Java suffixes like ``'1d'``.
    Pass ``dtype`` when the column is already numeric to skip the text path.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, NUMERIC_TYPES):
        d = col.cast("double")
        return F.when(~F.isnan(d), d)
    s = col.cast("string")
    # Only text the regex accepts reaches the cast: a failing string->double cast is
    # signalled by an exception inside the JVM, far costlier than the regex test.
    # The regex also drops spellings the cast would accept ("1d", "0x1p3", "NaN").
    return F.when(s.rlike(NUM_RE), F.trim(s).try_cast("double"))


def df_num(df, name: str) -> Column:
    """``to_num`` for a column of ``df``, typed by the frame's schema."""
    return to_num(F.col(name), df.schema[name].dataType)


def round_r(c: Column | str, digits: int = 2) -> Column:
    """Round half to even on the decimal candidates, like R >= 4.0 ``round``.

    Takes the nearer of floor/ceil at ``10^-digits``; on an exact tie the one
    whose scaled floor is even. ``round(2.675, 2)`` -> 2.67 and
    ``round(0.125, 2)`` -> 0.12, where Spark's ``round`` gives 2.68 / 0.13.
    """
    x = F.col(c) if isinstance(c, str) else c
    p = float(10 ** digits)
    ax = F.abs(x)
    x10 = ax * F.lit(p)
    i10 = F.floor(x10)
    xd = i10 / F.lit(p)
    xu = F.ceil(x10) / F.lit(p)
    du = xu - ax
    dd = ax - xd
    r = F.when((du < dd) | ((du == dd) & (F.pmod(i10, F.lit(2)) == 1)), xu).otherwise(xd)
    out = F.when(x < 0, -r).otherwise(r)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(out + F.lit(0.0))
