"""Create-date discovery and column-level datetime parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that mark a create-date column, tried first
# (case-insensitive, anywhere in the name), then generic date/time fragments.
CREATE_DATE_FRAGMENTS = ["create_date", "created_date", "created_datetime", "create_datetime",
                         "create_date_", "create_dateentity", "create"]
DATE_FRAGMENTS = ["date", "time", "timestamp", "datetime"]
# A column is a date column by content if its first 30 non-null values (in
# record order) are at least 3, of which at least 60% start like an ISO date-time.
SNIFF_FIRST = 30
SNIFF_MIN = 3
SNIFF_SHARE = 0.6
ISO_PREFIX_RE = r"^\d{4}-\d{2}-\d{2}[T ]"

TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

_YMD = r"(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})"
_HMS = r"(\d{1,2})[:.]?(\d{1,2})[:.]?(\d{1,2}(?:\.\d+)?)"
_ZONE = r"\s*(Z|UTC|[+-]\d{2}:?\d{2})?\s*$"
YMD_HMS_RE = r"^\s*" + _YMD + r"(?:T|\s+|)" + _HMS + _ZONE
YMD_RE = r"^\s*" + _YMD + r"\s*$"


def find_datetime_col(df: DataFrame) -> str | None:
    """Column holding the record's create date: by name, then by content."""
    names = df.columns
    if not names:
        return None
    for fragments in (CREATE_DATE_FRAGMENTS, DATE_FRAGMENTS):
        pat = re.compile("|".join(fragments), re.IGNORECASE)
        for n in names:
            if pat.search(n):
                return n
    hits = {r["c"]: r["hits"] / r["n"] for r in _first_values(df).collect() if r["n"] >= SNIFF_MIN}    # one row per column
    return next((n for i, n in enumerate(names) if hits.get(i, 0) >= SNIFF_SHARE), None)


def _first_values(df: DataFrame) -> DataFrame:
    """Per column number: how many of its first non-null values there are, and how many start like a date-time.

    One pass for all columns. Records are ordered by ``id``, else by their text; a task keeps no more than
    SNIFF_FIRST values of a column before the shuffle.
    """
    value = lambda n: F.col(f"`{n}`").cast("string")
    record = value("id") if "id" in df.columns else F.to_json(F.struct(*[value(n).alias(f"c{i}") for i, n in enumerate(df.columns)]))
    cells = df.select(record.alias("k"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), value(n).alias("v")) for i, n in enumerate(df.columns)])).alias("x")).select("k", "x.*")
    place = F.row_number().over(Window.partitionBy("c").orderBy("k", "v"))
    first = cells.where(F.col("v").isNotNull()).withColumn("place", place).where(F.col("place") <= SNIFF_FIRST)
    return first.groupBy("c").agg(F.count("v").alias("n"), F.count_if(F.col("v").rlike(ISO_PREFIX_RE)).alias("hits"))


def _tz(z: Column) -> Column:
    return F.when((z == "") | (z == "Z") | z.isNull(), F.lit("UTC")).otherwise(z)


def parse_ymd_hms(c: Column) -> Column:
    """Date-time with any of ``-/.`` or no separators, optional ``T``, fraction and zone."""
    s = c.cast("string")
    g = lambda i: F.regexp_extract(s, YMD_HMS_RE, i)
    zone = F.regexp_extract(s, YMD_HMS_RE, 7)
    zone = F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"),
                                                       F.substring(zone, 4, 2))).otherwise(zone)
    ts = F.try_make_timestamp(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"),
                              g(4).cast("int"), g(5).cast("int"), g(6).cast("decimal(16,6)"), _tz(zone))
    return F.when(s.rlike(YMD_HMS_RE), ts)


def parse_ymd(c: Column) -> Column:
    s = c.cast("string")
    g = lambda i: F.regexp_extract(s, YMD_RE, i)
    ts = F.try_make_timestamp(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"),
                              F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(s.rlike(YMD_RE), ts)


def datetime_candidates(c: Column) -> list[Column]:
    """Parsers tried in order, each applied to the whole column."""
    return [
        parse_ymd_hms(c),
        F.coalesce(parse_ymd_hms(c), parse_ymd(c)),
        c.cast("string").try_cast("timestamp"),
    ]


def parse_datetime(df: DataFrame, name: str) -> DataFrame:
    """Replace ``name`` with a timestamp, choosing one parser for the whole column.

    Per-row ``coalesce`` of parsers would treat mixed-format columns differently,
    so one small aggregate counts the hits of every candidate (a single scan of
    that column) and the first candidate with any hit wins. Time-typed columns
    pass through.
    """
    if name is None or name not in df.columns:
        return df
    dtype = df.schema[name].dataType
    if isinstance(dtype, TIME_TYPES):
        return df
    c = F.col(f"`{name}`")
    cands = datetime_candidates(c)
    hits = df.agg(*[F.count(x).alias(f"h{i}") for i, x in enumerate(cands)]).first()
    chosen = next((x for i, x in enumerate(cands) if hits[f"h{i}"] > 0), cands[0])
    return df.withColumn(name, chosen)
