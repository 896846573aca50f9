"""Top-1 per key (latest record per subject, first record per subject).

Written as a grouped ``min`` over one struct (order, tiebreak, row) instead of
``row_number().over(partitionBy(key))``: the minimum aggregates partially on the
map side, so a subject holding a third of all rows is reduced to one candidate
per map task before the shuffle. Struct buffers plan as a sort aggregate: a map task sorts its own
rows by key, the tasks after the shuffle one row per key and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import NUMERIC_TYPES


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _descending_key(df: DataFrame, order: str) -> Column:
    """A column that sorts ascending in the order ``order`` sorts descending."""
    dt = df.schema[order].dataType
    c = _q(order)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return -F.unix_date(c)
    if isinstance(dt, NUMERIC_TYPES):
        d = c.cast("double")
        return F.when(~F.isnan(d), -d)
    if isinstance(dt, T.BooleanType):
        return -c.cast("int")
    raise TypeError(f"cannot order by column {order!r} of type {dt.simpleString()}; "
                    "parse it to a timestamp or number first")


def _orderable(dt) -> bool:
    return not isinstance(dt, (T.MapType, T.VariantType))


def top1_per_key(df: DataFrame, key: str | Sequence[str], order: str | None = None,
                 tiebreak: str | None = None) -> DataFrame:
    """One row per ``key``: largest ``order`` (NULLs last), ties to the smallest ``tiebreak``,
    remaining ties to the smallest whole row (in column order).

    ``order=None`` keeps the first row by ``tiebreak`` (the "first record" rule).
    A group whose ``order`` is NULL everywhere still yields one row.
    Source row order is not stable in Spark, so ``tiebreak`` stands in for it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if all(c in keys for c in df.columns):
        return df.distinct()
    parts = []
    if order is not None:
        parts.append(_q(order).isNull().alias("o_null"))
        parts.append(_descending_key(df, order).alias("o"))
    rest = [c for c in df.columns if c not in keys]
    if tiebreak is not None and tiebreak not in keys:
        parts.append(_q(tiebreak).alias("t"))
    # last resort: the smallest whole row (in column order) wins, so the pick is deterministic
    # even when the tiebreak itself repeats
    row_key = [_q(c) for c in rest if _orderable(df.schema[c].dataType)]
    if row_key:
        parts.append(F.struct(*row_key).alias("row"))
    plain = len(row_key) == len(rest)
    if plain:      # one struct holds the order and the row, which therefore travels once
        best = F.min(F.struct(*parts))
        agg = df.groupBy(*[_q(k) for k in keys]).agg(best.alias("_best")).select(
            *[_q(k) for k in keys], F.col("_best.row").alias("_top"))
    else:          # maps and variants cannot be compared
        packed = F.struct(*[_q(c) for c in rest])
        agg = df.groupBy(*[_q(k) for k in keys]).agg(F.min_by(packed, F.struct(*parts)).alias("_top"))
    return agg.select(*[_q(k) for k in keys], *[F.col(f"_top.`{c}`").alias(c) for c in rest]) \
        .select(*[_q(c) for c in df.columns])


def latest_per_key(df: DataFrame, key, order: str, tiebreak: str | None = "id") -> DataFrame:
    return top1_per_key(df, key, order, tiebreak if tiebreak in df.columns else None)


def first_per_key(df: DataFrame, key, tiebreak: str | None = "id") -> DataFrame:
    return top1_per_key(df, key, None, tiebreak if tiebreak in df.columns else None)
