"""Running totals and ranks that do not put a whole group into one task.

A plain ``row_number() over (partition by g order by v)`` sends every row of ``g``
to a single task. Here rows are range-partitioned on (keys, order), so one heavy
group is spread over many slices; each slice is ranked on its own and shifted by
the totals of the slices before it. The slices are checkpointed because range
bounds are sampled and must not move between the two passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.session import cut_lineage


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Add ``run_<name>`` (inclusive running sum) and ``all_<name>`` (group sum) per measure.

    ``order`` must be unique inside a group, otherwise equal rows share no fixed order.
    """
    keys = list(keys)
    names = list(measures)
    base = df.select("*", *[measures[n].alias(f"_m_{n}") for n in names])
    if not keys:
        base = base.withColumn("_all", F.lit(0))
        keys = ["_all"]
    ranged = base.repartitionByRange(*[F.col(k) for k in keys], *order)
    ranged = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))

    slices = ranged.groupBy("_slice", *keys).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    by_key = W.partitionBy(*keys)
    before = by_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # Only groups cut by a slice border need a shift: at most two per slice, so the
    # table is bounded by the number of partitions and may be broadcast.
    shifts = (
        slices.select(
            F.col("_slice").alias("_sl"),
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.count("*").over(by_key).alias("_parts"),
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
            *[F.sum(f"_s_{n}").over(by_key).alias(f"_tot_{n}") for n in names],
        )
        .filter("_parts > 1")
        .drop("_parts")
    )
    match = F.col("_slice") == F.col("_sl")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = W.partitionBy("_slice", *keys)
    ordered = local.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranged.select(
        "*",
        *[F.sum(f"_m_{n}").over(ordered).alias(f"_r_{n}") for n in names],
        *[F.sum(f"_m_{n}").over(local).alias(f"_t_{n}") for n in names],
    )
    joined = ranked.join(F.broadcast(shifts), match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_r_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(f"run_{n}") for n in names],
        *[F.coalesce(F.col(f"_tot_{n}"), F.col(f"_t_{n}")).alias(f"all_{n}") for n in names],
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``position`` (1-based row number) and ``group_rows``."""
    ranked = running_totals(df, keys, order, {"rows": F.lit(1).cast("bigint")})
    return ranked.withColumnsRenamed({"run_rows": "position", "all_rows": "group_rows"})


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Quantile with linear interpolation per group: (keys, name).

    ``percentile`` keeps all distinct values of a group in one buffer; here they are
    counted, ordered over many slices and only the two neighbours of the quantile kept.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(values, keys, [F.col(value)], {"n": F.col("_c")})
    place = F.lit(p) * (F.col("all_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    start = F.col("run_n") - F.col("_c")

    def at(i: Column) -> Column:
        return F.max(F.when((start <= i) & (i < F.col("run_n")), F.col(value).cast("double")))

    ends = ranked.groupBy(*keys).agg(at(low).alias("_lo"), at(high).alias("_hi"), F.max(place - low).alias("_w"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias(name))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """Average rank per distinct value: (keys, value, ties, rank, group_rows).

    Ties are collapsed before the shuffle, so a value shared by a third of the rows
    is one row here.
    """
    weight = F.col(count) if count else F.lit(1).cast("bigint")
    values = df.groupBy(*keys, value).agg(F.sum(weight).alias("ties"))
    ranked = running_totals(values, keys, [F.col(value)], {"n": F.col("ties")})
    return ranked.select(
        *keys,
        value,
        "ties",
        (F.col("run_n") - (F.col("ties") - 1) / 2.0).alias("rank"),
        F.col("all_n").alias("group_rows"),
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group, with their ``position``.

    Each task keeps n rows per group before the shuffle, so a heavy group does not meet in
    one task; no ranking of all rows and no stored copy is needed.
    """
    place = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
    return df.withColumn("position", place.cast("bigint")).filter(F.col("position") <= n)
