"""Bootstrap inference as joins: replicate and drawn index are ordinary columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.hashing import drawn_index, mixed_hash, string_code
from tallyveil.operators.ordering import exact_quantile, positions
from tallyveil.session import cut_lineage

REPLICATES = 2000  # fixed value: bootstrap size of the published intervals


def resampled_means(stats: DataFrame, group: str, unit: str, values: Sequence[str], replicates: int = REPLICATES,
                    seed: int = 0) -> DataFrame:
    """Mean of ``values`` per (group, replicate) over units drawn with replacement.

    Every replicate draws as many units as the group has. Slots are exploded over the
    replicates and look up the drawn unit; partial sums per (group, replicate) are combined
    before the shuffle.
    """
    kept = stats.select(group, unit, *values)
    for v in values:
        kept = kept.filter(F.col(v).isNotNull() & ~F.isnan(v))
    placed = positions(kept, [group], [F.col(unit)])
    slots = placed.select(
        group, F.col("position").alias("_slot"), F.col("group_rows").alias("_size"),
        (string_code(F.col(group)) + F.lit(seed)).alias("_seed"),
    )
    draws = slots.withColumn(
        "replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint")))
    )
    pick = drawn_index(F.col("replicate"), F.col("_seed"), F.col("_size"), F.col("_slot")) + 1
    drawn = draws.select(group, "replicate", pick.alias("position"))
    joined = drawn.join(placed.drop("group_rows", unit), [group, "position"])
    return joined.groupBy(group, "replicate").agg(*[F.avg(v).alias(v) for v in values])


def percentile_interval(draws: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Exact percentiles of one aggregated value per replicate."""
    return draws.groupBy(*by).agg(
        F.percentile(value, F.lit(low)).alias("ci_low"), F.percentile(value, F.lit(high)).alias("ci_high"),
        F.count(value).alias("replicates"),
    )


def bootstrap_macro(stats: DataFrame, value: str, category: str = "category", district: str = "district",
                    replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """M-18: point and interval of the macro mean, districts resampled inside categories."""
    kept = cut_lineage(stats.filter(F.col(value).isNotNull()).select(category, district, value))
    point = kept.groupBy(category).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias("point"))
    means = resampled_means(kept, category, district, [value], replicates, seed)
    per_draw = means.groupBy("replicate").agg(F.avg(value).alias("_draw"))
    # Both sides are single rows.
    return point.crossJoin(percentile_interval(per_draw, "_draw"))


def pair_models(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = ("category", "district")) -> DataFrame:
    """J-17: the same districts scored by two models."""
    left = a.select(*keys, F.col(value).alias(f"{value}_a"))
    return left.join(b.select(*keys, F.col(value).alias(f"{value}_b")), list(keys))


def bootstrap_delta(paired: DataFrame, value: str, category: str = "category", district: str = "district",
                    replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """M-19: interval of macro(b) - macro(a) with the same districts drawn for both models."""
    d = paired.withColumn("delta", F.col(f"{value}_b") - F.col(f"{value}_a"))
    return bootstrap_macro(d, "delta", category, district, replicates, seed)


def bootstrap_by_category(paired: DataFrame, value: str, category: str = "category", district: str = "district",
                          replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """M-20: one paired interval per category, NULL with fewer than two districts."""
    d = paired.withColumn("delta", F.col(f"{value}_b") - F.col(f"{value}_a")).filter("delta IS NOT NULL")
    d = cut_lineage(d.select(category, district, "delta"))
    point = d.groupBy(category).agg(F.avg("delta").alias("point"), F.count("*").alias("districts"))
    draws = resampled_means(d, category, district, ["delta"], replicates, seed)
    out = point.join(percentile_interval(draws, "delta", [category]), category)
    few = F.col("districts") < 2
    return out.withColumns({c: F.when(~few, F.col(c)) for c in ("point", "ci_low", "ci_high")}).drop("replicates")


def significance(df: DataFrame, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """M-22, first part: the interval excludes zero."""
    return df.withColumn("significant", (F.col(low) > 0) | (F.col(high) < 0))


def replication(df: DataFrame, expected: Column, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """M-22, second part: does the interval agree with the expected sign (positive, negative, ns)?"""
    flag = (
        F.when(expected == "positive", F.col(low) > 0)
        .when(expected == "negative", F.col(high) < 0)
        .otherwise((F.col(low) <= 0) & (F.col(high) >= 0))
    )
    return df.withColumn("replicates_expected", flag)


def median_split(stats: DataFrame, quality: DataFrame, district: str = "district", ratio: str = "ratio") -> DataFrame:
    """M-23: mark every district as high or low quality relative to the median district."""
    middle = exact_quantile(quality, [], ratio, 0.5, "_median")  # a single row
    halves = quality.crossJoin(middle).select(
        district, F.when(F.col(ratio) >= F.col("_median"), "high").otherwise("low").alias("half")
    )
    return stats.join(halves, district)


def placebo_permutation(df: DataFrame, keys: Sequence[str], unit: str, value: str, seed: int) -> DataFrame:
    """W-09: values permuted among the units of a group; group totals stay the same."""
    keys = list(keys)
    receive = positions(df.select(*keys, unit), keys, [F.col(unit)]).drop("group_rows")
    shuffled = df.select(*keys, unit, value, mixed_hash(F.col(unit), seed).alias("_h"))
    give = positions(shuffled, keys, [F.col("_h"), F.col(unit)]).select(*keys, "position", F.col(value).alias("placebo"))
    return receive.join(give, [*keys, "position"]).drop("position")


def cell_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """M-24 / M-26: mean and sample deviation per design cell; NaN and NULL are ignored."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))


def paired_contrast(df: DataFrame, cell: str, seed_col: str, value: str, hi: str, lo: str) -> DataFrame:
    """Difference hi - lo per seed, pairs with a missing side dropped."""
    pick = {name: F.max(F.when(F.col(cell) == name, F.when(~F.isnan(value), F.col(value)))) for name in (hi, lo)}
    wide = df.filter(F.col(cell).isin(hi, lo)).groupBy(seed_col).agg(pick[hi].alias("_hi"), pick[lo].alias("_lo"))
    return wide.filter("_hi IS NOT NULL AND _lo IS NOT NULL").select(seed_col, (F.col("_hi") - F.col("_lo")).alias("delta"))


def interaction(df: DataFrame, cell: str, seed_col: str, value: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """M-25: difference of two differences, paired by seed."""
    a = paired_contrast(df, cell, seed_col, value, *first).withColumnRenamed("delta", "_a")
    b = paired_contrast(df, cell, seed_col, value, *second).withColumnRenamed("delta", "_b")
    return a.join(b, seed_col).select(seed_col, (F.col("_a") - F.col("_b")).alias("delta"))


def bootstrap_pairs(deltas: DataFrame, name: str, seed_col: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """M-21: interval of the mean difference over seeds."""
    d = deltas.withColumn("contrast", F.lit(name))
    draws = resampled_means(d, "contrast", seed_col, ["delta"], replicates, seed)
    point = d.groupBy("contrast").agg(F.avg("delta").alias("point"), F.count("*").alias("pairs"))
    return point.join(percentile_interval(draws, "delta", ["contrast"]), "contrast")


def weight_contrast(df: DataFrame, by: Sequence[str], unit: str, weight: str, total: str) -> DataFrame:
    """M-28: mean weight of units at or above the median positive total minus the rest."""
    totals = df.groupBy(unit).agg(F.max(total).alias("_total"))
    middle = exact_quantile(totals.filter("_total > 0"), [], "_total", 0.5, "_median")
    cut = middle.agg(F.coalesce(F.max("_median"), F.lit(0.0)).alias("_cut"))  # a single row, also without positives
    marked = totals.crossJoin(cut).select(
        unit, F.when(F.col("_cut") > 0, F.col("_total") >= F.col("_cut")).otherwise(F.col("_total") > 0).alias("_high")
    )
    high = F.avg(F.when(F.col("_high"), F.col(weight)))
    low = F.avg(F.when(~F.col("_high"), F.col(weight)))
    return df.join(marked, unit).groupBy(*by).agg(high.alias("high"), low.alias("low"), (high - low).alias("delta"))


def sign_stability(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """M-28, second part: number of different signs over seeds; more than one means unstable."""
    sign = F.when(F.col(value) != 0, F.signum(value))
    return df.groupBy(*by).agg(F.count_distinct(sign).alias("signs"), F.count(value).alias("seeds"))


def degradation_curve(df: DataFrame) -> DataFrame:
    """M-27: per rate, mean and deviation of each skill and the share of seeds won by features."""
    columns = []
    for c in ("measurable", "actual", "persist"):
        columns += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return df.groupBy("rate").agg(
        *columns, F.avg(F.col("features_win").cast("double")).alias("share_features_win"), F.count("*").alias("seeds")
    )


def rolling_reference(df: DataFrame, order: str, value: str, ladder: str) -> DataFrame:
    """W-07: change against the last ladder row above; only ladder rows move the reference.

    The table has one row per model step, so the unpartitioned window is a handful of rows.
    """
    above = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(F.when(F.col(ladder), F.col(value)), ignorenulls=True).over(above)
    return df.withColumn("delta", F.when(F.col(ladder), F.col(value) - previous))
