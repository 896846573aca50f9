"""Subject groups from an uploaded ID list: uploaded IDs vs everything else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRIM_CHARS

G1, G2, ALL = "G1", "G2", "ALL"
# Report labels.
OTHERS_LABEL = "Everything else"
SINGLE_LABEL = "Everything"
DEFAULT_G1_LABEL = "Group 1"


@dataclass
class Grouping:
    mode: str            # "two" or "single"
    n_all: int
    n_g1: int
    n_g2: int
    g1_label: str | None
    g2_label: str


def clean_ids(ids: DataFrame) -> DataFrame:
    """One text column ``id``: trimmed, blanks dropped, distinct."""
    c = ids.columns[0]
    t = F.btrim(F.col(f"`{c}`").cast("string"), F.lit(TRIM_CHARS))
    return ids.select(t.alias("id")).where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()


def mark_groups(df: DataFrame, ids: DataFrame | None, id_col: str = "id", name: str = "grp") -> DataFrame:
    """Add ``name``: G1 for subjects in ``ids``, G2 for the rest (NULL ids included).

    The join's strategy is left to the optimiser, which knows the list's measured size.
    """
    if ids is None:
        return df.withColumn(name, F.lit(ALL))
    marker = clean_ids(ids).select(F.col("id").alias("_gid"), F.lit(True).alias("_in"))
    key = F.col(f"`{id_col}`").cast("string")
    j = df.join(marker, key == F.col("_gid"), "left")
    return j.select(*[F.col(f"`{c}`") for c in df.columns],
                    F.when(F.col("_in"), F.lit(G1)).otherwise(F.lit(G2)).alias(name))


def group_counts(df: DataFrame, ids: DataFrame | None, id_col: str = "id") -> DataFrame:
    """Distinct subjects per group (one row per group present)."""
    subj = df.select(F.col(f"`{id_col}`")).distinct()
    return mark_groups(subj, ids, id_col).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def assign_groups(df: DataFrame, ids: DataFrame | None, label: str | None = None,
                  id_col: str = "id") -> Grouping:
    """Two groups iff an ID list is given and both groups are non-empty, else one."""
    counts = {r["grp"]: r["n"] for r in group_counts(df, ids, id_col).collect()}  # <= 2 rows
    n_all = sum(counts.values())
    n1, n2 = counts.get(G1, 0), counts.get(G2, 0)
    if ids is not None and n1 > 0 and n2 > 0:
        return Grouping("two", n_all, n1, n2, label or DEFAULT_G1_LABEL, OTHERS_LABEL)
    return Grouping("single", n_all, 0, 0, None, OTHERS_LABEL)


BUCKET_BITS = 32768         # of a bitmap function's bucket
MOST_BUCKETS = 8192         # of an id filter: 32 MB
BITS_PER_ID = 16


def listed_only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be in ``ids`` (first column), by a broadcast bit set: all listed rows and a few others.

    Meant to run with the scan, before rows are grouped or shuffled; an exact semi-join afterwards drops the others. The bit set has
    BITS_PER_ID bits an id up to a fixed size, beyond which only more rows pass.
    """
    kind = df.schema[key].dataType
    text = ids.select(F.col(f"`{ids.columns[0]}`").cast(kind).cast("string").alias("id")).where(F.col("id").isNotNull())
    buckets = min(MOST_BUCKETS, 1 + text.count() * BITS_PER_ID // BUCKET_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * BUCKET_BITS)) + 1
    bits = (text.select(place(F.col("id")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits")))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    marked = df.withColumn("_place", place(F.col(f"`{key}`").cast("string")))
    return (marked.join(F.broadcast(bits), F.bitmap_bucket_number("_place") == F.col("_bucket"))      # at most MOST_BUCKETS rows
            .where(hit).select(*[F.col(f"`{c}`") for c in df.columns]))
