"""Rater agreement, declared tallies and literature screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.text import groups_hit


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """M-33: counts of both raters' decisions."""
    return df.groupBy(F.col(a).alias("first"), F.col(b).alias("second")).agg(F.count("*").alias("records"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """M-33: agreement, chance agreement and kappa, from the confusion counts."""
    c = confusion(df, a, b)
    n = c.agg(F.sum("records").alias("n"), F.sum(F.when(F.col("first") == F.col("second"), F.col("records")).otherwise(0)).alias("same"))
    rows = c.groupBy(F.col("first").alias("label")).agg(F.sum("records").alias("ra"))
    cols = c.groupBy(F.col("second").alias("label")).agg(F.sum("records").alias("rb"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("rb")), F.lit(0.0)).alias("_c"))
    out = n.crossJoin(chance)  # two single rows
    po, pe = F.col("same") / F.col("n"), F.col("_c") / (F.col("n").cast("double") * F.col("n"))
    return out.select("n", po.alias("agreement"), pe.alias("chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def disagreements(df: DataFrame, record: str, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(record, a, b)


def tally_check(df: DataFrame, dimensions: Sequence[str], declared: DataFrame) -> DataFrame:
    """M-34: declared counts (dimension, value, declared) against the counted ones."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counted = df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("counted"))
    joined = declared.join(counted, ["dimension", "value"], "full_outer").fillna(0, ["declared", "counted"])
    return joined.withColumn("passed", F.col("declared") == F.col("counted"))


def missing_identifier(df: DataFrame, key: str, identifier: str) -> DataFrame:
    return df.filter(F.coalesce(F.trim(identifier), F.lit("")) == "").select(key)


def near_misses(papers: DataFrame, text: str, groups: Sequence[Sequence[str]], known: DataFrame, key: str, venue: str) -> DataFrame:
    """F-12: per venue, papers outside the known set that hit all or exactly all but one group."""
    hits = papers.join(known.select(key), key, "left_anti").withColumn("_g", groups_hit(F.col(text), groups))
    full = len(groups)
    per_venue = hits.groupBy(venue).agg(
        F.count("*").alias("screened"), F.count_if(F.col("_g") == full).alias("near_miss"),
        F.count_if(F.col("_g") == full - 1).alias("partial"),
    )
    total = per_venue.agg(F.sum("screened").alias("_all"))
    return per_venue.crossJoin(total).withColumn("share", F.col("screened") / F.col("_all")).drop("_all")


def protocol_shares(papers: DataFrame, flags: Sequence[str]) -> DataFrame:
    """G-12: number and share of papers that use each protocol."""
    pairs = F.array(*[F.struct(F.lit(f).alias("protocol"), F.col(f).cast("double").alias("used")) for f in flags])
    return papers.select(F.explode(pairs).alias("p")).groupBy("p.protocol").agg(
        F.sum("p.used").cast("bigint").alias("papers"), F.avg("p.used").alias("share"), F.count("*").alias("total")
    )
