"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partitions=(), fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a table, as parquet (optionally partitioned) or CSV with ``NA`` for missing."""
    writer = df.write.mode(mode)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if fmt == "csv":
        writer.option("nullValue", "NA").csv(path, header=True)
    else:
        writer.format(fmt).save(path)
    return path


def write_report_table(df: DataFrame, path: str, run_date: str, first_year: int) -> str:
    """CSV output stamped with its first year and its run date (``YYYYMMDD``).

    A second run on a date replaces the first one's output.
    """
    target = f"{path}/first_year={first_year}/run_date={run_date}"
    return write_table(df, target, fmt="csv", mode="overwrite")
