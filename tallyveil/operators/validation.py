"""Composition, concordance audits, external anchors and re-zoning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.codes import per_100k, weight_or_zero, zero_pad
from tallyveil.functions.hashing import mixed_hash
from tallyveil.operators.ranking import area_correlations
from tallyveil.session import literal_rows


def response_share(answers: DataFrame, answer: str, weight: str, high: Sequence[str] = ("3", "4"),
                   valid: Sequence[str] = ("1", "2", "3", "4")) -> DataFrame:
    """A-34 / P-04: weighted share of high answers per area among valid answers."""
    w = weight_or_zero(weight)
    value = F.trim(F.col(answer))
    kept = answers.filter(value.isin(list(valid)))
    total = F.sum(w)
    return kept.groupBy("area").agg(
        total.alias("_t"), F.sum(F.when(value.isin(list(high)), w).otherwise(0.0)).alias("_h"), F.count("*").alias("respondents")
    ).filter("_t > 0").select("area", (F.col("_h") / F.col("_t")).alias("share"), "respondents")


def wave_counts(cells: DataFrame) -> DataFrame:
    """A-35: number of waves in which a category was measured."""
    return cells.groupBy("category").agg(F.count_distinct(F.when(F.col("sw") > 0, F.col("year"))).alias("waves"))


def composition_table(observed_latent: DataFrame, survey: DataFrame) -> DataFrame:
    """A-36, first part: category shares of observed, latent, raw and annualised survey totals.

    One row per category, so the window over the whole table is a handful of rows.
    """
    joined = observed_latent.join(survey, "category").withColumn("annual", F.col("survey") / F.col("waves"))
    everything = W.partitionBy(F.lit(0))
    shares = {f"share_{c}": F.col(c) / F.sum(c).over(everything) for c in ("observed", "latent", "survey", "annual")}
    return joined.withColumns(shares)


def renormalise(shares: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """A-37, first part: shares restricted to a comparable subset, summing to one again."""
    kept = shares.filter(F.col("category").isin(list(keep))) if keep is not None else shares
    everything = W.partitionBy(F.lit(0))
    return kept.withColumns({c: F.col(c) / F.sum(c).over(everything) for c in shares.columns if c.startswith("share_")})


def l1_distances(shares: DataFrame) -> DataFrame:
    """A-36 / A-37, second part: L1 of observed and latent composition on both survey bases."""
    def l1(a: str, b: str):
        return F.sum(F.abs(F.col(f"share_{a}") - F.col(f"share_{b}")))

    return shares.agg(
        l1("observed", "annual").alias("l1_observed_annual"), l1("latent", "annual").alias("l1_latent_annual"),
        l1("observed", "survey").alias("l1_observed_raw"), l1("latent", "survey").alias("l1_latent_raw"),
    )


def person_years(population: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """A-38."""
    kept = population.filter(F.col("year").isin(list(years))) if years is not None else population
    return kept.groupBy("area").agg(F.sum("population").alias("person_years"))


def require_denominator(areas: DataFrame, denominator: DataFrame) -> DataFrame:
    """P-10: areas without a denominator; empty means the gate passes."""
    return areas.select("area").distinct().join(denominator, "area", "left_anti")


def concordance_audit(table: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """A-39: count and rate correlations side by side, so the population effect is visible.

    ``table`` has one row per (by, area): observed, latent, survey, person_years.
    """
    by = list(by)
    d = table.withColumns({
        "_o": F.col("observed") / F.col("person_years"), "_l": F.col("latent") / F.col("person_years"),
        "_v": F.col("survey") / F.col("person_years"),
    })
    pairs = {
        "rho_counts": ("observed", "survey"), "rho_observed": ("_o", "_v"), "rho_latent": ("_l", "_v"),
        "rho_population": ("person_years", "observed"),
    }
    out = area_correlations(d, by, pairs).drop("n")
    return out.withColumn("delta", F.col("rho_latent") - F.col("rho_observed"))


def with_total(df: DataFrame, keys: Sequence[str], values: Sequence[str], label: str = "TOTAL", category: str = "category") -> DataFrame:
    """J-09: category rows plus a total row over categories, from one grouping-sets pass."""
    keys = list(keys)
    grouped = df.groupingSets([[*keys, category], keys], *keys, category).agg(
        *[F.sum(v).alias(v) for v in values], F.grouping(category).alias("_g")
    )
    return grouped.withColumn(category, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(category))).drop("_g")


def anchor_grid(panel: DataFrame) -> DataFrame:
    """A-40: correlations with an external anchor for each (year or pooled) x category.

    ``panel``: area, year, category, observed, latent, population, anchor_count, anchor_rate.
    """
    d = panel.withColumns({
        "observed_rate": per_100k(F.col("observed"), F.col("population")),
        "latent_rate": per_100k(F.col("latent"), F.col("population")),
        "scope": F.explode(F.array(F.col("year").cast("string"), F.lit("pooled"))),
    })
    by = ["scope", "category"]
    pairs = {
        "rho_observed": ("anchor_rate", "observed_rate"), "rho_latent": ("anchor_rate", "latent_rate"),
        "rho_observed_counts": ("anchor_rate", "observed"), "rho_population": ("population", "observed"),
        "rho_countcount": ("anchor_count", "observed"),
    }
    return area_correlations(d, by, pairs).withColumn("delta", F.col("rho_latent") - F.col("rho_observed"))


def wins(grid: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """A-41: scopes in which latent beats observed, among those where both are defined."""
    defined = F.col("delta").isNotNull()
    return grid.groupBy(*by).agg(F.count_if(defined & (F.col("delta") > 0)).alias("wins"), F.count_if(defined).alias("defined"))


def yearly_summary(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """A-42."""
    columns = []
    for v in values:
        columns += [F.sum(v).alias(f"{v}_sum"), F.avg(v).alias(f"{v}_mean")]
    return df.groupBy("year").agg(*columns)


def availability_profile(answers: DataFrame, crosswalk: DataFrame, prefix: str) -> DataFrame:
    """A-47: valid rows and victims per category and year; NULL where no code exists.

    ``answers``: year, schema, area, subtype, victim. ``crosswalk``: category, schema, codes.
    """
    per_code = answers.groupBy("year", "schema", "subtype").agg(
        F.count("*").alias("rows"), F.count_if("victim").alias("victims"),
        F.count_if(F.col("victim") & F.coalesce(zero_pad("area").startswith(prefix), F.lit(False))).alias("local"),
    )
    years = per_code.groupBy("year", "schema").agg(F.sum("rows").alias("rows"))
    wanted = years.join(crosswalk, "schema")
    codes = wanted.select("year", "schema", "category", F.explode("codes").alias("subtype"))
    hits = codes.join(per_code.drop("rows"), ["year", "schema", "subtype"], "left").groupBy("year", "schema", "category").agg(
        F.sum(F.coalesce("victims", F.lit(0))).alias("victims"), F.sum(F.coalesce("local", F.lit(0))).alias("local_victims")
    )
    return wanted.drop("codes").join(hits, ["year", "schema", "category"], "left")


def category_shares(counts: DataFrame, category: str = "category", value: str = "count") -> DataFrame:
    """A-48: total and share per category, largest first."""
    totals = counts.groupBy(category).agg(F.sum(value).alias("total"))
    share = F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0)))
    return totals.withColumn("share", share).orderBy(F.desc("total"), category)


def linear_trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """A-50."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def year_composition(surface: DataFrame, categories: Sequence[str], year: int) -> DataFrame:
    """M-30: shares of observed and latent in one year; absent categories count as zero."""
    listed = literal_rows(surface.sparkSession, [(c,) for c in categories], "category string")
    sums = surface.filter(F.col("year") == year).groupBy("category").agg(F.sum("observed").alias("observed"), F.sum("latent").alias("latent"))
    d = listed.join(sums, "category", "left").fillna(0.0, ["observed", "latent"])
    everything = W.partitionBy(F.lit(0))
    return d.withColumns({
        f"share_{c}": F.col(c) / F.nullif(F.sum(c).over(everything), F.lit(0.0)) for c in ("observed", "latent")
    }).withColumn("delta_share", F.col("share_latent") - F.col("share_observed"))


# ---- re-zoning ----------------------------------------------------------------------

def rezone(areas: DataFrame, scales: Sequence[int], replicates: int, area_key: str = "area_key") -> DataFrame:
    """A-43: balanced random zones: areas in seeded hash order, dealt round-robin to k zones.

    A group is one shuffled area list, so the window is bounded by the number of areas.
    """
    spread = areas.select(
        "area", area_key, F.explode(F.array(*[F.lit(k) for k in scales])).alias("k"),
    ).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    seed = F.col("rep") * F.lit(1009) + F.col("k")
    order = W.partitionBy("k", "rep").orderBy(mixed_hash(F.col(area_key), seed), area_key)
    return spread.withColumn("zone", F.pmod(F.row_number().over(order) - 1, F.col("k"))).drop(area_key)


def zone_distances(zones: DataFrame, table: DataFrame) -> DataFrame:
    """A-44: per (k, rep), mean L1 to the annualised survey weighted by the zone's survey mass.

    ``table``: area, category, observed, latent, annual. Empty zones are skipped.
    """
    z = ["k", "rep", "zone"]
    sums = zones.join(table, "area").groupBy(*z, "category").agg(*[F.sum(c).alias(c) for c in ("observed", "latent", "annual")])
    whole = W.partitionBy(*z)
    shares = sums.withColumns({f"_{c}": F.sum(c).over(whole) for c in ("observed", "latent", "annual")})

    def l1(c: str):
        gap = F.abs(F.col(c) / F.col(f"_{c}") - F.col("annual") / F.col("_annual"))
        return F.sum(F.when((F.col(f"_{c}") > 0) & (F.col("_annual") > 0), gap)).alias(f"l1_{c}")

    per_zone = shares.groupBy(*z, "_annual").agg(l1("observed"), l1("latent"))

    def mean(c: str):
        w = F.when(F.col(c).isNotNull(), F.col("_annual"))
        return (F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0.0))).alias(c)

    return per_zone.groupBy("k", "rep").agg(mean("l1_observed"), mean("l1_latent"))


def zone_correlations(zones: DataFrame, table: DataFrame) -> DataFrame:
    """A-45: rank correlation of zone totals with the survey, at least three zones."""
    totals = zones.join(table, "area").groupBy("k", "rep", "zone").agg(*[F.sum(c).alias(c) for c in ("observed", "latent", "annual")])
    pairs = {"rho_observed": ("observed", "annual"), "rho_latent": ("latent", "annual")}
    return area_correlations(totals, ["k", "rep"], pairs).drop("n")


def scale_sweep(distances: DataFrame, correlations: DataFrame, min_scale: int = 12) -> DataFrame:
    """A-46: mean and population deviation over replicates per scale, share where latent is closer."""
    rho = correlations.filter(F.col("k") >= min_scale)
    joined = distances.join(rho, ["k", "rep"], "left")
    return joined.groupBy("k").agg(
        F.count("*").alias("reps"),
        F.avg("l1_observed").alias("l1_observed_mean"), F.avg("l1_latent").alias("l1_latent_mean"),
        F.stddev_pop("l1_observed").alias("l1_observed_sd"), F.stddev_pop("l1_latent").alias("l1_latent_sd"),
        F.avg("rho_observed").alias("rho_observed"), F.avg("rho_latent").alias("rho_latent"),
        F.avg((F.col("l1_latent") < F.col("l1_observed")).cast("double")).alias("share_latent_closer"),
    )
