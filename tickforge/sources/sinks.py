"""Sinks: Parquet/CSV bar tables and JSON metrics, always to a fresh location."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickforge.operators.merge import sort_bars


def write_bars(df: DataFrame, path: str, fmt: str = "parquet",
               partition_by_symbol: bool = True) -> str:
    """Overwrite ``path`` with bars, one folder per symbol (partition pruning
    for single-symbol reads), sorted by date inside files."""
    w = sort_bars(df).write.mode("overwrite")
    if partition_by_symbol:
        w = w.partitionBy("symbol")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Plain CSV with header; never the directory being read."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
