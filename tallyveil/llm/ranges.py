"""Rows dealt out into ranges of their ids, so that a table can be read in order by many tasks."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_numbers(df: DataFrame, doc_id: str, ranges: int, descending: bool = False):
    """A function that adds ``bucket``, the number of the id's range in the given order; rows without id form the last range.

    Bounds are approximate quantiles of the ids alone. Equal ids share a range.
    """
    edges = df.select(F.col(doc_id).alias("_id")).approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    last = len(splits) - 2
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="bucket", handleInvalid="keep") if last else None

    def place(rows: DataFrame) -> DataFrame:
        if not last:  # a single range
            return rows.withColumn("bucket", F.when(F.col(doc_id).isNull(), 1).otherwise(0).cast("int"))
        number: Column = F.lit(last) - F.col("bucket") if descending else F.col("bucket")
        placed = cut.transform(rows.withColumn("_id", F.col(doc_id).cast("double")))
        return placed.withColumn("bucket", F.when(F.col(doc_id).isNull(), last + 1).otherwise(number).cast("int")).drop("_id")

    return place
