"""Latent surfaces: observed counts divided by reporting rates, intervals and disaggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.codes import per_100k
from tallyveil.session import cut_lineage

UNSTABLE_RATE = 0.05  # fixed value: rates below are flagged as unstable


def observed_counts(events: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """F-16 / A-15: events mapped to categories (unmapped dropped) and counted."""
    return (
        events.join(mapping, label).groupBy("area", "category", "year").agg(F.sum("count").alias("observed"))
    )


def attach_rates(observed: DataFrame, rates: DataFrame, population: DataFrame) -> DataFrame:
    """J-03: observed counts with rate and population where they exist."""
    return observed.join(rates, ["area", "category"], "left").join(population, ["area", "year"], "left")


def exclusion_reason(joined: DataFrame) -> DataFrame:
    """P-07: why a row cannot be inverted; NULL when it can."""
    r = F.col("r_hat")
    reason = F.when(r.isNull(), "no rate").when(F.isnan(r) | (r <= 0) | (r == float("inf")), "rate not usable")
    return joined.withColumn("reason", reason)


def invert(joined: DataFrame) -> DataFrame:
    """A-14: latent value with flipped interval, factor, rate per 100k and unstable flag."""
    usable = exclusion_reason(joined).filter("reason IS NULL").drop("reason")
    o, r = F.col("observed"), F.col("r_hat")
    return usable.withColumns({
        "latent": o / r,
        "latent_low": F.when(F.col("r_high") > 0, o / F.col("r_high")),
        "latent_high": F.when(F.col("r_low") > 0, o / F.col("r_low")),
        "factor": 1.0 / r,
        "latent_per_100k": per_100k(o / r, F.col("population")),
        "unstable": (r < UNSTABLE_RATE).cast("int"),
    })


def pooled_multiplier(surface: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """A-16: sum of latent over sum of observed, flagged above 1 / 0.05."""
    o, latent = F.sum("observed"), F.sum("latent")
    return surface.groupBy(*by).agg(
        o.alias("observed"), latent.alias("latent"), (latent / F.greatest(o, F.lit(1))).alias("multiplier"),
        F.coalesce((o > 0) & (latent / F.nullif(o, F.lit(0)) > 1.0 / UNSTABLE_RATE), F.lit(False)).alias("unstable"),
    )


def area_multiplier(surface: DataFrame) -> DataFrame:
    """A-17: per area, areas without observed events left out."""
    return surface.groupBy("area").agg(F.sum("observed").alias("_o"), F.sum("latent").alias("_l")).filter("_o > 0").select(
        "area", (F.col("_l") / F.col("_o")).alias("multiplier")
    )


def multiplier_band(surface: DataFrame) -> DataFrame:
    """A-18: band of the multiplier; truncated if any upper bound is missing."""
    sums = surface.groupBy("category").agg(
        F.sum("observed").alias("_o"), F.sum("latent").alias("_l"),
        F.sum(F.coalesce("latent_low", F.lit(0.0))).alias("_lo"), F.sum(F.coalesce("latent_high", F.lit(0.0))).alias("_hi"),
        F.bool_or(F.col("latent_high").isNull()).alias("truncated"), F.bool_or(F.col("unstable") == 1).alias("unstable"),
    )
    o = F.col("_o")
    return sums.filter("_o > 0").select(
        "category", (F.col("_l") / o).alias("multiplier"), (F.col("_lo") / o).alias("band_low"),
        (F.col("_hi") / o).alias("band_high"), "truncated", "unstable",
    )


def delta_deviation(rates: DataFrame) -> DataFrame:
    """A-21: delta-method standard deviation of observed / rate."""
    a, b = F.col("alpha"), F.col("beta")
    variance = a * b / ((a + b) ** 2 * (a + b + 1.0))
    return rates.withColumns({
        "latent": F.col("observed") / F.col("r_hat"),
        "sd_delta": F.sqrt(F.col("observed") ** 2 / F.col("r_hat") ** 4 * variance),
    })


def monte_carlo_interval(rates: DataFrame, by: Sequence[str] = ("category",), draws: int = 200_000, seed: int = 0,
                         chunk: int = 10_000) -> DataFrame:
    """A-22 / A-23: interval of sum(y / r) / sum(y) with independent Beta draws per area.

    Areas are exploded over chunks of draws; a chunk is one row in and ``chunk`` partial
    values out, already summed per Arrow batch, so the shuffle carries (draw, partial sum).
    """
    by = list(by)
    base = cut_lineage(rates.filter("r_hat > 0 AND observed > 0").select(
        *by, "area", F.col("observed").cast("double").alias("observed"), "alpha", "beta", "r_hat"
    ))
    chunks = -(-draws // chunk)
    spread = base.select("*", F.xxhash64(*by, "area").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"))
    spread = spread.repartition(*by, "_c")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.select(*by).schema)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, group in pdf.groupby([*by, "_c"], sort=False):
                c = int(keys[-1])
                size = min(chunk, draws - c * chunk)
                total = np.zeros(size)
                for y, a, b, k in zip(group["observed"], group["alpha"], group["beta"], group["_k"]):
                    rng = np.random.default_rng([seed, c, k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF])
                    total += y / np.maximum(rng.beta(a, b, size), 1e-300)
                out = pd.DataFrame({"draw": np.arange(c * chunk, c * chunk + size), "part": total})
                for name, value in zip(by, keys):
                    out[name] = value
                yield out[[*by, "draw", "part"]]

    partial = spread.mapInPandas(draw, f"{fields}, draw bigint, part double")
    sums = base.groupBy(*by).agg(
        F.sum("observed").alias("_y"), (F.sum(F.col("observed") / F.col("r_hat")) / F.sum("observed")).alias("point"),
        F.count("*").alias("areas"),
    )
    per_draw = partial.groupBy(*by, "draw").agg(F.sum("part").alias("_p"))
    ends = per_draw.groupBy(*by).agg(F.percentile("_p", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    out = sums.join(ends, by).select(
        *by, "areas", "point", (F.col("_q")[0] / F.col("_y")).alias("ci_low"), (F.col("_q")[1] / F.col("_y")).alias("ci_high")
    )
    return near_floor(out)


def near_floor(intervals: DataFrame) -> DataFrame:
    """A-23: the whole interval lies above the point, so the inversion is not stable."""
    return intervals.withColumn("unstable_inversion", F.col("ci_low") > F.col("point"))


def population_weights(cells: DataFrame) -> DataFrame:
    """W-02: share of the district population; without any population 1/n per cell.

    District totals are pre-aggregated and joined; no district is gathered in one task.
    """
    pop = F.coalesce(F.col("population"), F.lit(0.0))
    totals = cells.groupBy("district").agg(F.sum(pop).alias("_pop"), F.count("*").alias("_n"))
    return cells.join(totals, "district").withColumn(
        "weight", F.when(F.col("_pop") > 0, pop / F.col("_pop")).otherwise(1.0 / F.col("_n"))
    ).drop("_pop", "_n")


def dirichlet_share(df: DataFrame, keys: Sequence[str], count: str, prior: str, smooth: float) -> DataFrame:
    """W-03: (count + M prior) / (group count + M)."""
    totals = df.groupBy(*keys).agg(F.sum(count).alias("_g"))
    share = (F.col(count) + F.lit(smooth) * F.col(prior)) / (F.col("_g") + F.lit(smooth))
    return df.join(totals, list(keys)).withColumn("share", share).drop("_g")


def disaggregate(weights: DataFrame, surface: DataFrame, values: Sequence[str]) -> DataFrame:
    """J-19 / ML-19: district value times the weight of the cell inside its district."""
    joined = weights.join(surface, "district")
    return joined.withColumns({v: F.col(v) * F.col("weight") for v in values})


def hybrid_surface(weights: DataFrame, surface: DataFrame, points: DataFrame, values: Sequence[str], smooth: float = 10.0) -> DataFrame:
    """ML-20 / J-20: geocoded pattern smoothed towards the population prior, district totals kept.

    Points are summed per cell *and* district first, so a border cell is never duplicated.
    """
    keys = ["cell", "district", "year", "category"]
    counts = points.groupBy(*keys).agg(F.sum("count").cast("double").alias("_c"))
    # District totals come from the small count table, not from a second pass over the joined surface.
    group = ["district", "year", "category"]
    totals = counts.join(weights.select("cell", "district"), ["cell", "district"], "left_semi").groupBy(*group).agg(F.sum("_c").alias("_g"))
    joined = weights.join(surface, "district").join(counts, keys, "left").join(totals, group, "left").fillna(0.0, ["_c", "_g"])
    share = (F.col("_c") + F.lit(smooth) * F.col("weight")) / (F.col("_g") + F.lit(smooth))
    shared = joined.withColumn("share", share).drop("_g")
    return shared.withColumns({v: F.col(v) * F.col("share") for v in values}).drop("_c", "weight").withColumnRenamed("share", "weight")


def rate_map(surface: DataFrame, person_years: DataFrame) -> DataFrame:
    """A-49: observed, latent and gap per 100,000 person-years."""
    sums = surface.groupBy("area").agg(F.sum("observed").alias("o"), F.sum("latent").alias("l"))
    o, latent = per_100k(F.col("o"), F.col("person_years")), per_100k(F.col("l"), F.col("person_years"))
    return sums.join(person_years, "area").select(
        "area", o.alias("observed_rate"), latent.alias("latent_rate"), (latent - o).alias("gap")
    )


def constant_factor_check(surface: DataFrame, keys: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """M-29: is latent / observed constant inside each group? Shares and worst spread."""
    pos = surface.filter("observed > 0 AND latent > 0").withColumn("_f", F.col("latent") / F.col("observed"))
    # Deviations are merged around the means of the parts, so large factors lose no digits.
    g = pos.groupBy(*keys).agg(
        F.count_distinct("_f").alias("_distinct"), F.count("*").alias("_n"), F.min("_f").alias("_lo"), F.max("_f").alias("_hi"), F.stddev_samp("_f").alias("_dev"),
    )
    sd = F.when((F.col("_n") < 2) | (F.col("_lo") == F.col("_hi")), 0.0).otherwise(F.col("_dev"))
    return g.withColumn("_sd", sd).agg(
        F.count("*").alias("groups"), F.avg((F.col("_sd") < tolerance).cast("double")).alias("share_constant"),
        F.max("_sd").alias("max_sd"), F.max("_distinct").alias("max_distinct"),
    )


