"""Running sums / products over an ordered column without a single-task window.

``Window.orderBy(t)`` with no partition key moves every row into one task. Here the
ordered column is cut into ranges; each range computes its
own running values in parallel (a window partitioned by range), and the totals of
earlier ranges (one row per partition key and range) are added (or multiplied) back in. Results equal the single-window result up to
floating-point association.

Ranges follow from a value alone: 4096 of equal width in every interval between powers of two. So no job
looks for quantiles, every plan cuts alike, and the number of ranges of a key is bounded by the reach of its values.

The input is expected to be an aggregate (one row per key and order value), small
next to the scan it came from; ``add_ranges`` materialises it once so that the branches of the
plan do not recompute the upstream shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RANGE = "_range"


OCTAVE = 4096           # ranges between two powers of two
OUTER = 1 << 30         # range of infinite values; missing ones and NaN lie beyond


def value_range(order: Column) -> Column:
    """Number of the range that holds a value: never smaller for a larger value, like the order of a window."""
    x = order.cast("double")
    a = F.abs(x)
    power = F.floor(F.log2(F.greatest(a, F.lit(5e-324))))
    inner = F.floor((a / F.pow(F.lit(2.0), power) - 1) * OCTAVE)
    size = F.when(a < 1e-300, F.lit(0)).otherwise(((power + 1100) * OCTAVE + inner).cast("int"))
    return (F.when(x.isNull(), F.lit(-2 * OUTER + 1)).when(F.isnan(x), F.lit(OUTER + 1)).when(x == float("inf"), F.lit(OUTER))
            .when(x == float("-inf"), F.lit(-OUTER)).when(x < 0, -size).otherwise(size))


def add_ranges(df: DataFrame, order: str, n_ranges: int | None = None,
               rel_err: float = 0.001) -> tuple[DataFrame, int]:
    """Materialise ``df`` and add a ``_range`` column cutting ``order`` by value, or at quantiles into ``n_ranges``.

    Returns the frame and its number of quantile ranges, or zero for ranges by value. Infinite and missing values go to
    the outer ranges; a frame without a finite cut is one range.
    """
    if n_ranges is None:
        return materialize(df).withColumn(RANGE, value_range(F.col(order))), 0
    if n_ranges <= 1:
        return df, 1
    df = materialize(df)
    probs = [i / n_ranges for i in range(1, n_ranges)]
    cuts = df.approxQuantile(order, probs, min(rel_err, 0.1 / n_ranges))
    finite = sorted({float(c) for c in cuts if c is not None and math.isfinite(c)})
    if not finite:
        return df, 1
    splits = [float("-inf"), *finite, float("inf")]
    tmp = "_range_input"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=RANGE, handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(order).cast("double")))
    return out.withColumn(RANGE, F.col(RANGE).cast("int")).drop(tmp), len(splits) - 1


def running(df: DataFrame, order: str, partition_by: Sequence[str] = (),
            sums: Mapping[str, Column] | None = None,
            products: Mapping[str, Column] | None = None, n_ranges: int = 1) -> DataFrame:
    """Add inclusive running ``sums`` / ``products`` ordered by ``order`` within ``partition_by``.

    ``n_ranges`` comes from ``add_ranges``: unless it is one, ``df`` carries ``_range``; one range is a
    plain window per partition key.
    ``order`` must be unique within each partition key.
    """
    sums = dict(sums or {})
    products = dict(products or {})
    names = list(sums) + list(products)
    base = df
    for name, expr in {**sums, **products}.items():
        base = base.withColumn(f"_v_{name}", expr)

    def window_cols(keys, prefix):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ([F.sum(f"_v_{n}").over(w).alias(f"{prefix}{n}") for n in sums]
                + [F.product(f"_v_{n}").over(w).alias(f"{prefix}{n}") for n in products])

    if n_ranges == 1:
        return base.select("*", *window_cols(list(partition_by), "")).drop(*[f"_v_{n}" for n in names])

    keys = list(partition_by) + [RANGE]
    out = base.select("*", *window_cols(keys, "_in_"))
    # one row per (partition key, range)
    tot = base.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
                                  *[F.product(f"_v_{n}").alias(f"_t_{n}") for n in products])
    w_prev = Window.partitionBy(*partition_by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys,
                      *[F.coalesce(F.sum(f"_t_{n}").over(w_prev), F.lit(0)).alias(f"_o_{n}") for n in sums],
                      *[F.coalesce(F.product(f"_t_{n}").over(w_prev), F.lit(1.0)).alias(f"_o_{n}")
                        for n in products])
    same = F.lit(True)
    for k in keys:                      # a missing order value or key has its own range
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    out = out.alias("a").join(offs.alias("b"), same, "inner").select(
        "a.*", *[F.col(f"b._o_{n}") for n in names])
    for name in sums:
        out = out.withColumn(name, F.col(f"_o_{name}") + F.col(f"_in_{name}"))
    for name in products:
        out = out.withColumn(name, F.col(f"_o_{name}") * F.col(f"_in_{name}"))
    return out.drop(*[f"_{p}_{n}" for n in names for p in ("v", "in", "o")])
