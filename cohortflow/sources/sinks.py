"""Result sinks: merged table, distribution export and Table 1 report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.distribution import distribution_export


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Merged / flattened tables: a distributed write, one file per partition."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_distribution(dist: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export view of a percentage distribution (NULL value spelled N/A), ordered output."""
    distribution_export(dist).orderBy("Percentage", ascending=False) \
        .write.mode(mode).option("header", True).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Table 1 report as one csv file in row order (tens of rows: a single file is fine). Indented labels stay indented."""
    (report.orderBy("ord").coalesce(1).write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
