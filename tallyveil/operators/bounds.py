"""Partial identification of a reporting rate when some victims hide from the survey."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.operators.rates import wilson

NU_GRID = (1.0, 0.995, 0.99, 0.975, 0.95, 0.90)  # fixed values: assumed sensitivity of the survey


def scope_rows(df: DataFrame, area: Column, prefixes: Sequence[str], local: str = "local") -> DataFrame:
    """P-03: every row in the national scope, rows of the listed areas also in the local one."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.coalesce(area.startswith(p), F.lit(False))
    scopes = F.when(inside, F.array(F.lit("nacional"), F.lit(local))).otherwise(F.array(F.lit("nacional")))
    return df.withColumn("scope", F.explode(scopes))


def person_flags(records: DataFrame, person: Sequence[str], category: str = "category") -> DataFrame:
    """A-30, first part: one row per person and category, any subtype counts."""
    return records.groupBy(*person, category).agg(
        F.max("weight").alias("weight"), F.bool_or(F.col("victim")).alias("victim"),
        F.bool_or(F.col("victim") & F.col("reported")).alias("reported"),
    )


def prevalence(flags: DataFrame, people: DataFrame, available: Mapping[str, Sequence[int]], by: Sequence[str] = ("scope",)) -> DataFrame:
    """A-30, second part: weighted prevalence and reporting per scope and category.

    The base of a category counts only people of years whose questionnaire asks for it.
    """
    by = list(by)
    defined = F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.array(*[F.lit(y) for y in ys]).alias("years")) for c, ys in available.items()
    ]))
    yearly = people.groupBy(*by, "year").agg(F.sum("weight").alias("w"))
    base = yearly.withColumn("d", defined).filter(F.array_contains("d.years", F.col("year"))).groupBy(
        *by, F.col("d.category").alias("category")
    ).agg(F.sum("w").alias("w_base"))
    v, w = F.col("victim"), F.col("weight")
    sums = flags.groupBy(*by, "category").agg(
        F.sum(F.when(v, w)).alias("w_x"), F.sum(F.when(v, w * w)).alias("sw2"),
        F.coalesce(F.sum(F.when(F.col("reported"), w)), F.lit(0.0)).alias("w_rx"), F.count_if(v).alias("n_x"),
    )
    out = sums.join(base, [*by, "category"]).filter("w_x > 0 AND w_base > 0").withColumns({
        "px": F.col("w_x") / F.col("w_base"), "prx": F.col("w_rx") / F.col("w_base"),
        "rate": F.col("w_rx") / F.col("w_x"), "n_eff": F.col("w_x") ** 2 / F.col("sw2"),
    })
    low, high = wilson(F.col("rate"), F.col("n_eff"))
    return out.withColumns({"ci_low": low, "ci_high": high})


def on_nu_grid(df: DataFrame, grid: Sequence[float] = NU_GRID) -> DataFrame:
    return df.withColumn("nu", F.explode(F.array(*[F.lit(v) for v in grid])))


def worst_case(px: Column, prx: Column, nu: Column) -> tuple[Column, Column]:
    """A-31."""
    hidden = F.lit(1.0) - nu
    return prx / (px + hidden), F.least(F.lit(1.0), (prx + hidden) / (px + hidden))


def monotone(px: Column, prx: Column, nu: Column) -> tuple[Column, Column]:
    """A-32: hidden victims report at most at the visible rate; falls back to the worst case
    where the upper bound is not increasing."""
    hidden = F.lit(1.0) - nu
    low, high = worst_case(px, prx, nu)
    gamma = prx / px * hidden
    den = px + F.lit(2.0) * gamma - hidden
    degrade = (den <= 0) | ((px - hidden) <= F.lit(2.0) * prx)
    tight = F.greatest(F.least(F.lit(1.0), (prx + gamma) / den), low)
    return low, F.when(degrade, high).otherwise(tight)


def bounds_table(rates: DataFrame, grid: Sequence[float] = NU_GRID) -> DataFrame:
    d = on_nu_grid(rates, grid)
    low, high = worst_case(F.col("px"), F.col("prx"), F.col("nu"))
    m_low, m_high = monotone(F.col("px"), F.col("prx"), F.col("nu"))
    return d.withColumns({"low": low, "high": high, "mono_low": m_low, "mono_high": m_high})


def collapse_threshold(bounds: DataFrame, by: Sequence[str], ratio: float = 2.0) -> DataFrame:
    """A-33: largest nu below one whose upper bound is at least twice the lower."""
    hit = (F.col("nu") < 1) & (F.col("low") > 0) & (F.col("high") / F.nullif(F.col("low"), F.lit(0.0)) >= ratio)
    return bounds.groupBy(*by).agg(F.max(F.when(hit, F.col("nu"))).alias("nu_collapse"))
