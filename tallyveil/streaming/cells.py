"""ST-01: the weighted cell sums, kept up to date over a stream.

All sums are mergeable, so a tumbling window with a watermark gives the same numbers as
the batch aggregation; windows that are still open show what has come in so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.session import scratch_path


def windowed_cells(stream: DataFrame, time: str, category: str, weight: str, reported: str, width: str, delay: str | None) -> DataFrame:
    """Sums per window and category; works on a stream and on a batch alike."""
    w = F.col(weight)
    timed = stream.withWatermark(time, delay) if delay else stream
    return timed.groupBy(F.window(time, width).alias("w"), category).agg(
        F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col(reported)).alias("swd"), F.count("*").alias("n")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), category, "sw", "sw2", "swd", "n")


def read_events(spark: SparkSession, path_glob: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet folder as a stream; zone-less times are read as UTC, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path_glob)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(result: DataFrame, keys: Sequence[str], label: str = "cells") -> DataFrame:
    """Run a stream over everything that is available; the table as it stands then, open windows included.

    Every batch writes the rows it changed (update mode) under its own number, and a batch that runs again replaces its files; of each key
    the row of the last batch counts. The watermark still bounds the state, and rows later than it are left out. State and output lie
    in the shared folder, so a lost executor resumes from there.
    """
    spark = result.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    kept = []

    def keep(batch: DataFrame, number: int) -> None:
        kept.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number:012d}")

    query = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if not kept:
        return spark.createDataFrame([], result.schema)
    schema = T.StructType([*result.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/_batch=*")
    values = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return last.select(*keys, "_v.*").select(*result.columns)
