"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> str:
    """IO-12: part files with a header row; NULL is written as an empty field."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
    return path


def write_surface(df: DataFrame, path: str, partition: Sequence[str] = ("year",)) -> str:
    """IO-13: Parquet partitioned by year, so readers of one year prune the others.

    Rows are rebalanced by the partition columns: adaptive execution splits a heavy year into
    several files of the advisory size and joins small ones.
    """
    df.hint("rebalance", *partition).write.mode("overwrite").partitionBy(*partition).parquet(path)
    return path


def nested_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IO-14: one JSON document per row: keys on top, the other columns nested."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.to_json(F.struct(*keys, F.struct(*rest).alias("values"))).alias("value"))


def write_json(df: DataFrame, keys: Sequence[str], path: str) -> str:
    nested_rows(df, keys).write.mode("overwrite").text(path)
    return path
