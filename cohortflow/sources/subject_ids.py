"""Uploaded subject-ID lists: text (one id per line) or delimited files (first column)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CohortError
from ..functions.text import TRIM_CHARS

# Column names preferred as the id column in spreadsheets.
ID_COLUMN_NAMES = ["id", "subject_id", "subjectid"]


def group_label(path: str) -> str:
    """Base name without extension: the label of the uploaded group."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def read_subject_ids(spark: SparkSession, path: str, fmt: str | None = None,
                     first_column: bool = True) -> DataFrame:
    """One column ``id``: trimmed, non-blank, distinct.

    ``txt``: every line. ``csv`` / ``tsv``: header row, first column (or, with
    ``first_column=False``, a column named id/subject_id/subjectid when present).
    Values stay text (no numeric re-parsing of ids). Spreadsheets are not read:
    export them to csv first.
    """
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "txt":
        raw = spark.read.text(path).select(F.col("value").alias("id"))
    elif fmt in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
        if not df.columns:
            raw = spark.createDataFrame([], "id string")
        else:
            col = df.columns[0]
            if not first_column:
                named = [c for c in df.columns if c.lower() in ID_COLUMN_NAMES]
                col = named[0] if named else col
            raw = df.select(F.col(f"`{col}`").cast("string").alias("id"))
    elif fmt in ("xlsx", "xls"):
        raise CohortError("spreadsheet ID files are not supported; save the sheet as csv")
    else:
        raise CohortError(f"unsupported ID file type: {fmt}")
    t = F.btrim(F.col("id"), F.lit(TRIM_CHARS))
    return raw.select(t.alias("id")).where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()


def subject_id_upload(spark: SparkSession, path: str, **kw) -> tuple[DataFrame | None, str | None]:
    """(ids, label), or (None, None) when the file holds no id (treated as no upload)."""
    ids = read_subject_ids(spark, path, **kw)
    if ids.limit(1).count() == 0:
        return None, None
    return ids, group_label(path)
