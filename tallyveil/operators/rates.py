"""Survey-weighted reporting rates and empirical-Bayes shrinkage."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import special
from tallyveil.functions.special import binomial_quantile
from tallyveil.functions.codes import capped_subcount, event_multiplicity, strict_int, compose_area, weight_or_null
from tallyveil.session import cut_lineage

ALL_AREAS = "_NAC"  # fixed value: label of the total row, unknown areas included
PHI_CAP = 100.0  # fixed value: upper limit of the published concentration
Z95 = 1.96  # fixed value
SUMS = ("sw", "sw2", "swd", "w_times", "w_times2", "w_pnp", "w_any", "n")


# ---- questionnaires to long records -------------------------------------------------

def detect_questionnaire(columns: Sequence[str], marker: str = "P615_") -> str:
    return "new" if any(c.upper().startswith(marker) for c in columns) else "classic"


def unpivot_questionnaire(wide: DataFrame, codes: Sequence[str], names: Mapping[str, str], person: str,
                          weight: str, year: int) -> DataFrame:
    """J-01: respondent x subtype records of one questionnaire.

    ``names`` maps the roles victim, times, any, count, reported, where, dep, prov, dist to
    column patterns with ``{x}`` for the subtype code. Missing columns become NULL.
    """
    present = {c.upper(): c for c in wide.columns}

    def value(role: str, code: str) -> Column:
        name = present.get(names[role].format(x=code).upper())
        return F.trim(F.col(name)) if name else F.lit(None).cast("string")

    structs = []
    for code in codes:
        reported = F.coalesce(value("reported", code) == "1", F.lit(False))
        police = reported & F.coalesce(value("where", code) == "1", F.lit(False))
        times = event_multiplicity(strict_int(value("times", code)))
        # A count column that exists but is unreadable counts as zero; only an absent
        # column falls back to the flag.
        has_count = names["count"].format(x=code).upper() in present
        raw_count = F.coalesce(strict_int(value("count", code)), F.lit(0).cast("bigint")) if has_count else F.lit(None).cast("bigint")
        structs.append(F.struct(
            F.lit(code).alias("subtype"),
            F.coalesce(value("victim", code) == "1", F.lit(False)).alias("victim"),
            compose_area(*[strict_int(value(p, code)) for p in ("dep", "prov", "dist")]).alias("area"),
            times.alias("times"),
            police.cast("int").alias("pnp"),
            capped_subcount(raw_count, times, police.cast("int")).alias("pnp_count"),
            capped_subcount(strict_int(value("any", code)), times, reported.cast("int")).alias("any_count"),
        ))
    return (
        wide.select(F.col(person).alias("person"), F.lit(year).alias("year"), weight_or_null(weight).alias("weight"),
                    F.explode(F.array(*structs)).alias("s"))
        .filter("s.victim AND weight IS NOT NULL")
        .select("person", "year", "weight", "s.subtype", "s.area", "s.times", "s.pnp", "s.pnp_count", "s.any_count")
    )


#: Column names of the two questionnaires, up to 2023 and from 2024 on, by role.
QUESTIONNAIRES = {
    "classic": {
        "victim": "P601_{x}", "times": "P602_{x}", "any": "P602E_{x}", "count": "P602F_{x}_1_ENT", "reported": "P606_{x}", "where": "P607_{x}",
        "dep": "P602B_{x}", "prov": "P602C_{x}", "dist": "P602D_{x}_COD",
    },
    "new": {
        "victim": "P615_{x}", "times": "P616_{x}", "any": "P617_{x}", "count": "P618_{x}_1_ENT", "reported": "P619_{x}", "where": "P620_{x}",
        "dep": "P623_{x}_COD", "prov": "P624_{x}_COD", "dist": "P625_{x}_COD",
    },
}


def unpivot_waves(waves: Mapping[int, DataFrame], codes: Mapping[str, Sequence[str]], person: str, weight: str) -> DataFrame:
    """J-01: records of several years' waves, each read by the questionnaire that its columns show; ``codes``: subtypes per questionnaire."""
    parts = []
    for year, wide in waves.items():
        kind = detect_questionnaire(wide.columns)
        parts.append(unpivot_questionnaire(wide, codes[kind], QUESTIONNAIRES[kind], person, weight, year))
    return reduce(DataFrame.unionByName, parts)


def attach_category(records: DataFrame, crosswalk: DataFrame, codes: str) -> DataFrame:
    """J-02: subtype code to category through the crosswalk's code array."""
    mapping = crosswalk.select("category", "panel", F.explode(codes).alias("subtype"))
    return records.join(mapping, "subtype")


# ---- sufficient statistics ----------------------------------------------------------

def weighted_cells(records: DataFrame) -> DataFrame:
    """A-01: sums per (year, category, area) plus a total row per (year, category).

    One scan: records are summed per area first, and each of these few sums is then counted for its area and for
    the total. Rows without an area feed the total only.
    """
    w, wt = F.col("weight"), F.col("weight") * F.col("times")
    sums = records.groupBy("year", "category", "area").agg(
        F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("pnp")).alias("swd"),
        F.sum(wt).alias("w_times"), F.sum(wt * wt).alias("w_times2"),
        F.sum(w * F.col("pnp_count")).alias("w_pnp"), F.sum(w * F.col("any_count")).alias("w_any"),
        F.count("*").alias("n"),
    )
    # The level keeps an area that bears the total row's label apart from it.
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("area").alias("area")), F.struct(F.lit(1).alias("level"), F.lit(ALL_AREAS).alias("area")))
    spread = sums.withColumn("_to", F.explode(levels)).filter("_to.area IS NOT NULL")
    return spread.groupBy("year", "category", F.col("_to.area").alias("area"), F.col("_to.level").alias("_level")).agg(
        *[F.sum(c).alias(c) for c in SUMS]
    ).drop("_level")


def pool_cells(cells: DataFrame, by: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    """A-08: add the sums of all years in scope first; effective sizes come afterwards."""
    scoped = cells.filter(F.col("year").isin(list(years))) if years is not None else cells
    return scoped.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def pool_scoped(cells: DataFrame, crosswalk: DataFrame, latest: int) -> DataFrame:
    """A-08 with scopes: panel categories use every year, the others the latest wave."""
    scope = F.when(F.col("panel"), "panel").otherwise("latest")
    kept = cells.join(crosswalk.select("category", "panel"), "category").filter(F.col("panel") | (F.col("year") == latest))
    return kept.groupBy("category", "area", scope.alias("scope")).agg(*[F.sum(c).alias(c) for c in SUMS])


def effective(cells: DataFrame, unit: str = "victim") -> DataFrame:
    """A-02 / A-03: Kish effective size, rate and pseudo-successes for persons or events."""
    total, square, hits = ("sw", "sw2", "swd") if unit == "victim" else ("w_times", "w_times2", "w_pnp")
    n_eff = F.when(F.col(square) > 0, F.col(total) ** 2 / F.col(square)).otherwise(0.0)
    p = F.when(F.col(total) > 0, F.col(hits) / F.col(total)).otherwise(0.0)
    return cells.withColumns({"n_eff": n_eff, "p": p, "y_eff": p * n_eff})


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """A-04."""
    size = F.when(n > 0, n)
    d = F.lit(1.0) + F.lit(z * z) / size
    c = p + F.lit(z * z) / (F.lit(2.0) * size)
    h = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / size + F.lit(z * z) / (F.lit(4.0) * size * size))
    low = F.coalesce(F.greatest(F.lit(0.0), (c - h) / d), F.lit(0.0))
    return low, F.coalesce(F.least(F.lit(1.0), (c + h) / d), F.lit(1.0))


def direct_rates(cells: DataFrame, prefix: str, scope: str = "LIMA") -> DataFrame:
    """A-05: category x year x {all areas, areas with the prefix} with interval and event rate."""
    # Each cell is dealt to the scopes it belongs to, so the cells are computed once.
    scopes = F.array(F.when(F.col("area") == ALL_AREAS, "NAC"), F.when(F.col("area").startswith(prefix), scope))
    grouped = pool_cells(cells.withColumn("scope", F.explode(scopes)).filter("scope IS NOT NULL"), ["category", "year", "scope"])
    rates = effective(grouped)
    low, high = wilson(F.col("p"), F.col("n_eff"))
    return rates.select(
        "category", "year", "scope", F.col("p").alias("rate"), low.alias("ci_low"), high.alias("ci_high"),
        F.when(F.col("w_times") > 0, F.col("w_pnp") / F.col("w_times")).alias("event_rate"), "n_eff", "n",
    )


def dispersion(cells: DataFrame, thresholds: Sequence[int] = (10, 30)) -> DataFrame:
    """A-06: share of area cells whose effective size reaches each threshold."""
    rated = effective(cells.filter(F.col("area") != ALL_AREAS))
    shares = [F.avg((F.col("n_eff") >= k).cast("double")).alias(f"share_{k}") for k in thresholds]
    return rated.agg(F.count("*").alias("cells"), *shares)


def sparsity_rule(cells: DataFrame, at_least: int = 30, percent: float = 70.0) -> DataFrame:
    """A-07: direct estimator A when enough pooled cells are large, otherwise B."""
    rated = effective(pool_cells(cells.filter(F.col("area") != ALL_AREAS), ["category", "area"]))
    share = 100.0 * F.avg((F.col("n_eff") >= at_least).cast("double"))
    return rated.agg(
        F.count("*").alias("cells"), F.median("n_eff").alias("median_n_eff"), F.max("n_eff").alias("max_n_eff"),
        share.alias("pct_large"), F.when(share >= percent, "A").otherwise("B").alias("estimator"),
    )


# ---- empirical Bayes ----------------------------------------------------------------

def with_loglik(df: DataFrame, y: str = "y_eff", n: str = "n_eff", mu: str = "mu", phi: str = "phi") -> DataFrame:
    """A-09: add ``value``, the log-likelihood of one cell; NULL for a mean outside (1e-4, 1 - 1e-4)."""
    out = special.with_lgamma(df, {
        name: F.expr(text) for name, text in {
            "_g1": f"{mu} * {phi} + {y}", "_g2": f"(1D - {mu}) * {phi} + greatest({n} - {y}, 0D)", "_g3": f"{phi} + {n}",
            "_g4": f"{mu} * {phi}", "_g5": f"(1D - {mu}) * {phi}", "_g6": phi,
        }.items()
    })
    value = f"CASE WHEN {mu} > 1e-4D AND {mu} < 0.9999D THEN (_g1 - _g4) + (_g2 - _g5) - (_g3 - _g6) END AS value"
    return out.selectExpr(*df.columns, value)


def likelihood_grid(cells: DataFrame, grid: Column, by: Sequence[str]) -> DataFrame:
    """Log-likelihood per grid point: (by, mu, phi, loglik, cells).

    ``grid`` is an array column of (mu, phi) structs; each cell is exploded over it and
    partial sums are combined before the shuffle.
    """
    spread = cells.filter("n_eff > 0").select(*by, "y_eff", "n_eff", F.explode(grid).alias("g"))
    scored = with_loglik(spread.select(*by, "y_eff", "n_eff", F.col("g.mu").alias("mu"), F.col("g.phi").alias("phi")))
    return scored.groupBy(*by, "mu", "phi").agg(
        F.sum("value").alias("loglik"), F.count("*").alias("cells")
    ).filter("loglik IS NOT NULL")


def _around(centre: Column, half: Column, steps: int) -> Column:
    """Evenly spaced values; the half width is a column, so rounds share their generated code."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: centre - half + i * (half * F.lit(2.0 / (steps - 1))))


def _grid(mu_logit: Column, mu_half: Column, phi_log: Column, phi_half: Column, steps: int) -> Column:
    """Array of (mu, phi) around a centre; the mean moves on the logit scale."""
    mus = F.transform(_around(mu_logit, mu_half, steps), lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
    phis = F.transform(_around(phi_log, phi_half, steps), lambda v: F.exp(v))
    return F.flatten(F.transform(mus, lambda m: F.transform(phis, lambda p: F.struct(m.alias("mu"), p.alias("phi")))))


def fit_shrinkage(cells: DataFrame, by: Sequence[str] = ("category",), rounds: int = 4, steps: int = 17,
                  cap: float | None = PHI_CAP) -> DataFrame:
    """A-10: mean and concentration per key by repeated grid refinement.

    Every round is one distributed aggregation over cells x grid; keys never leave the
    cluster. Fewer than three cells or no successes give the pooled mean with phi = 1.
    """
    by = list(by)
    base = cut_lineage(cells.filter("n_eff > 0").select(*by, "y_eff", "n_eff"))
    pooled = cut_lineage(base.groupBy(*by).agg(
        (F.sum("y_eff") / F.sum("n_eff")).alias("pooled"), F.sum("y_eff").alias("_y"), F.count("*").alias("cells")
    ))
    start = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("pooled")))
    best = pooled.select(*by, F.ln(start / (1 - start)).alias("_mu"), F.lit(math.log(30.0)).alias("_phi"),
                         F.lit(2.0).alias("_mh"), F.lit(8.0).alias("_ph"))
    for _ in range(rounds):
        spread = base.join(best, by).withColumn("grid", _grid(F.col("_mu"), F.col("_mh"), F.col("_phi"), F.col("_ph"), steps))
        # The half widths travel as keys, so a round reads the one before once and nothing is stored.
        widths = ["_mh", "_ph"]
        scored = likelihood_grid(spread, F.col("grid"), [*by, *widths])
        top = scored.groupBy(*by, *widths).agg(F.max_by(F.struct("mu", "phi", "loglik"), "loglik").alias("b"))
        best = top.select(
            *by, F.ln(F.col("b.mu") / (1 - F.col("b.mu"))).alias("_mu"), F.ln("b.phi").alias("_phi"),
            (F.col("_mh") / 6.0).alias("_mh"), (F.col("_ph") / 6.0).alias("_ph"), F.col("b.loglik").alias("loglik"),
        )
    weak = (F.col("cells") < 3) | (F.col("_y") <= 0)
    phi = F.exp("_phi") if cap is None else F.least(F.exp("_phi"), F.lit(cap))
    return pooled.join(best, by, "left").select(
        *by,
        F.when(weak, F.col("pooled")).otherwise(1.0 / (1.0 + F.exp(-F.col("_mu")))).alias("mu"),
        F.when(weak, F.lit(1.0)).otherwise(phi).alias("phi"),
        F.when(~weak, F.col("loglik")).alias("loglik"), "cells",
    )


def on_area_list(cells: DataFrame, areas: DataFrame, categories: Sequence[str]) -> DataFrame:
    """J-22: every listed area appears in every category, without survey rows as zero sums."""
    listed = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    frame = areas.select("area").distinct().select("area", listed)
    joined = frame.join(cells, ["category", "area"], "left")
    return joined.fillna(0.0, ["n_eff", "y_eff", "p"])


def posterior(cells: DataFrame, prior: DataFrame, by: Sequence[str] = ("category",), intervals: bool = False) -> DataFrame:
    """A-11 / A-13 / A-12: posterior mean per area; a zero prior mean gives an all-zero row.

    ``intervals`` adds the equal-tailed 95 % interval, which needs an Arrow UDF.
    """
    a = F.col("mu") * F.col("phi") + F.col("y_eff")
    b = (1 - F.col("mu")) * F.col("phi") + F.greatest(F.col("n_eff") - F.col("y_eff"), F.lit(0.0))
    usable = F.col("mu") > 0
    out = cells.join(prior.select(*by, "mu", "phi"), list(by)).withColumns({"alpha": a, "beta": b})
    out = out.withColumn("r_hat", F.when(usable, F.col("alpha") / (F.col("alpha") + F.col("beta"))).otherwise(0.0))
    if intervals:
        for name, level in (("r_low", 0.025), ("r_high", 0.975)):
            out = out.withColumn(name, F.when(usable, special.beta_quantile(level, F.col("alpha"), F.col("beta"))).otherwise(0.0))
    return out


def jeffreys_pooled(rates: DataFrame, by: Sequence[str], level: float = 0.80) -> DataFrame:
    """A-19: size-weighted pooled rate with a Jeffreys interval."""
    pooled = rates.groupBy(*by).agg(F.sum(F.col("rate") * F.col("n_eff")).alias("k"), F.sum("n_eff").alias("size"))
    tail = (1.0 - level) / 2.0
    a, b = F.col("k") + 0.5, F.col("size") - F.col("k") + 0.5
    return pooled.select(
        *by, (F.col("k") / F.col("size")).alias("rate"),
        special.beta_quantile(tail, a, b).alias("ci_low"), special.beta_quantile(1.0 - tail, a, b).alias("ci_high"),
    )


def rebuild_beta(rates: DataFrame) -> DataFrame:
    """A-20, first part: Beta parameters from the published mean, size and concentration."""
    total = F.col("phi") + F.col("n_eff")
    return rates.filter("r_hat > 0").withColumns({"alpha": F.col("r_hat") * total, "beta": (1 - F.col("r_hat")) * total})


def reconstruction_error(rates: DataFrame, tolerance: float = 0.006) -> DataFrame:
    """A-20, second part: worst distance of rebuilt to stored intervals, with the verdict."""
    b = rebuild_beta(rates)
    error = F.greatest(
        F.abs(special.beta_quantile(0.025, F.col("alpha"), F.col("beta")) - F.col("r_low")),
        F.abs(special.beta_quantile(0.975, F.col("alpha"), F.col("beta")) - F.col("r_high")),
    )
    return b.agg(F.max(error).alias("worst"), F.count("*").alias("cells")).withColumn("passed", F.col("worst") <= tolerance)


# ---- dispersion tests ---------------------------------------------------------------

def _climb_mean(base: DataFrame, start: DataFrame, by: Sequence[str], rounds: int, steps: int) -> DataFrame:
    """Best mean for each (by, phi) row of ``start``: its _mu is searched within _half, finer by 4 every round.

    Every round reads the one before once, so nothing is stored until the end.
    """
    best = start
    for _ in range(rounds):
        mus = F.transform(_around(F.col("_mu"), F.col("_half"), steps), lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
        spread = base.join(best, list(by)).select(*by, "phi", "_half", "y_eff", "n_eff", F.explode(mus).alias("mu"))
        scored = with_loglik(spread).groupBy(*by, "phi", "_half", "mu").agg(F.sum("value").alias("loglik")).filter("loglik IS NOT NULL")
        top = scored.groupBy(*by, "phi", "_half").agg(F.max_by("mu", "loglik").alias("mu"), F.max("loglik").alias("loglik"))
        best = top.select(*by, F.ln(F.col("mu") / (1 - F.col("mu"))).alias("_mu"), "phi", (F.col("_half") / 4.0).alias("_half"), "mu", "loglik")
    return cut_lineage(best.select(*by, "phi", "mu", "loglik"))


def profile_likelihood(cells: DataFrame, by: Sequence[str], phis: Sequence[float], rounds: int = 5, steps: int = 9) -> DataFrame:
    """Maximum over the mean at each fixed concentration: (by, phi, mu, loglik)."""
    by = list(by)
    base = cut_lineage(cells.filter("n_eff > 0").select(*by, "y_eff", "n_eff"))
    start = base.groupBy(*by).agg((F.sum("y_eff") / F.sum("n_eff")).alias("m"))
    clipped = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("m")))
    spelled = start.select(*by, F.ln(clipped / (1 - clipped)).alias("_mu"), F.explode(F.array(*[F.lit(float(p)) for p in phis])).alias("phi"), F.lit(1.5).alias("_half"))
    return _climb_mean(base, spelled, by, rounds, steps)


PHI_LOW, PHI_HIGH, PHI_POINTS = 10.0, 5000.0, 13  # fixed values: the interior of the profile
PHI_STEP = math.log(PHI_HIGH / PHI_LOW) / (PHI_POINTS - 1)
INTERIOR = tuple(PHI_LOW * math.exp(PHI_STEP * k) for k in range(PHI_POINTS))
HOMOGENEOUS = 1e6  # fixed value: concentration that stands for no heterogeneity


def interior_maximum(cells: DataFrame, by: Sequence[str], profile: DataFrame, rounds: int = 6, low: float = PHI_LOW, high: float = PHI_HIGH) -> DataFrame:
    """(by, phi, mu, loglik): the profile's interior maximum, refined between its grid points.

    Every round tries two points on either side of the best concentration, at half the distance
    of the round before, so phi is found to one part in a hundred after six rounds.
    """
    by = list(by)
    base = cut_lineage(cells.filter("n_eff > 0").select(*by, "y_eff", "n_eff"))

    def top(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(F.max_by(F.struct("phi", "mu"), "loglik").alias("t"), F.max("loglik").alias("loglik")).select(*by, "t.phi", "t.mu", "loglik")

    best, step = top(profile.filter((F.col("phi") >= low * (1 - 1e-9)) & (F.col("phi") <= high * (1 + 1e-9)))), PHI_STEP / 2
    for _ in range(rounds):
        near = F.array(*[F.least(F.greatest(F.col("phi") * F.lit(math.exp(k * step)), F.lit(low)), F.lit(high)) for k in (-2, -1, 0, 1, 2)])
        start = best.select(*by, F.ln(F.col("mu") / (1 - F.col("mu"))).alias("_mu"), F.explode(F.array_distinct(near)).alias("phi"), F.lit(0.06).alias("_half"))
        best, step = top(_climb_mean(base, start, by, 3, 5)), step / 2
    return best


def dispersion_test(cells: DataFrame, by: Sequence[str] = ("category",), phis: Sequence[float] = INTERIOR, rounds: int = 6) -> DataFrame:
    """A-24: interior maximum of the profile, likelihood ratio against no heterogeneity, p-values."""
    by = list(by)
    prof = profile_likelihood(cells, by, [*phis, HOMOGENEOUS])
    inner = interior_maximum(cells, by, prof, rounds).select(*by, F.col("phi").alias("phi_hat"), F.col("loglik").alias("_l1"))
    none = prof.filter(F.col("phi") == HOMOGENEOUS).select(*by, F.col("loglik").alias("_l0"))
    lrt = F.greatest(2.0 * (F.col("_l1") - F.col("_l0")), F.lit(0.0))
    out = inner.join(none, by).select(*by, "phi_hat", lrt.alias("lrt")).withColumn("p_value", special.chi2_tail(F.col("lrt")))
    return out.withColumn("p_boundary", F.col("p_value") / 2.0)


def dispersion_bootstrap(cells: DataFrame, by: Sequence[str] = ("category",), sims: int = 400, seed: int = 0,
                         phis: Sequence[float] = INTERIOR) -> DataFrame:
    """A-25: share of simulated common-rate data sets whose statistic reaches the observed one.

    Simulations are rows: cells are exploded over the simulation number, and each row turns a
    uniform number, the hash of (seed, simulation, cell), into a binomial draw, so a retried
    task draws the same.
    """
    by = list(by)
    base = cut_lineage(cells.filter("n_eff > 0").select(*by, "area", "y_eff", "n_eff"))
    mean = base.groupBy(*by).agg((F.sum("y_eff") / F.sum("n_eff")).alias("mu0"))
    size = F.greatest(F.bround("n_eff"), F.lit(1.0)).cast("bigint")
    sim = base.join(mean, by).select(
        *by, "area", size.alias("n"), "mu0", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"),
    )
    place = F.pmod(F.xxhash64(F.lit(seed), "sim", *by, "area"), F.lit(1 << 52))
    sim = sim.withColumn("u", (place + F.lit(0.5)) / F.lit(float(1 << 52)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sim.select(*by).schema)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = binomial_quantile(pdf["u"].to_numpy(), pdf["n"].to_numpy(), pdf["mu0"].to_numpy())
            yield pdf[by].assign(sim=pdf["sim"], y_eff=hits.astype(float), n_eff=pdf["n"].astype(float))

    drawn = sim.mapInPandas(draw, f"{fields}, sim int, y_eff double, n_eff double")
    simulated = dispersion_test(cut_lineage(drawn), [*by, "sim"], phis, 3).select(*by, F.col("lrt").alias("sim_lrt"))
    observed = dispersion_test(base, by, phis, 3).select(*by, "lrt")
    p = (F.sum((F.col("sim_lrt") >= F.col("lrt")).cast("int")) + 1) / (F.count("*") + 1)
    return simulated.join(observed, by).groupBy(*by, "lrt").agg(
        p.alias("p_boot"), F.percentile("sim_lrt", F.lit(0.95)).alias("q95"), F.count("*").alias("sims")
    )


def design_effect_scan(cells: DataFrame, by: Sequence[str] = ("category",), kappas: Sequence[float] = (0.5, 0.75, 1.25, 1.5)) -> DataFrame:
    """A-26: the test repeated with effective sizes scaled by kappa; kappa is a key column."""
    scaled = cells.withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in kappas]))).withColumns(
        {"y_eff": F.col("y_eff") * F.col("kappa"), "n_eff": F.col("n_eff") * F.col("kappa")}
    )
    return dispersion_test(scaled, [*by, "kappa"])


def shrinkage_sweep(cells: DataFrame, covariate: DataFrame, caps: Sequence[float] = (10.0, 100.0, 1000.0, 1e6)) -> DataFrame:
    """A-27: multipliers under several concentrations and their rank correlation with a covariate.

    Besides the caps, every category is shown under its own fitted, uncapped concentration (``fitted``).
    """
    from tallyveil.operators.ranking import spearman_of_areas, with_p_value

    fixed = profile_likelihood(cells, ["category"], caps).select("category", "phi", "mu", F.lit(False).alias("fitted"))
    prof = fixed.unionByName(fit_shrinkage(cells, cap=None).select("category", "phi", "mu", F.lit(True).alias("fitted")))
    joined = cells.filter("n_eff > 0").join(prof, "category").join(covariate, "area")
    a0 = F.col("mu") * F.col("phi")
    m = joined.withColumn("multiplier", (F.col("n_eff") + F.col("phi")) / (F.col("y_eff") + a0))
    spread = m.groupBy("category", "phi", "fitted").agg(
        F.min("multiplier").alias("low"), F.max("multiplier").alias("high"), F.stddev_pop("multiplier").alias("sd")
    )
    rho = with_p_value(spearman_of_areas(m, ["category", "phi", "fitted"], "covariate", "multiplier"))
    return spread.join(rho, ["category", "phi", "fitted"])


def definition_scan(cells: DataFrame, observed: DataFrame, definitions: Mapping[str, Sequence[str]]) -> DataFrame:
    """A-28: refit under alternative code sets with the observed counts held fixed."""
    variants = F.array(*[
        F.struct(F.lit(name).alias("definition"), F.array(*[F.lit(c) for c in codes]).alias("codes"))
        for name, codes in definitions.items()
    ])
    spread = cells.withColumn("v", F.explode(variants)).filter(F.array_contains("v.codes", F.col("category")))
    pooled = pool_cells(spread.withColumn("definition", F.col("v.definition")), ["definition", "area"])
    rated = cut_lineage(effective(pooled.filter(F.col("area") != ALL_AREAS)))
    prior = fit_shrinkage(rated, ["definition"])
    post = posterior(rated, prior, ["definition"]).join(observed, "area")
    total = rated.groupBy("definition").agg(F.sum("n_eff").alias("total_n_eff"))
    mult = post.filter("r_hat > 0").groupBy("definition").agg(
        (F.sum(F.col("observed") / F.col("r_hat")) / F.sum("observed")).alias("multiplier")
    )
    return prior.select("definition", "mu", "phi").join(total, "definition").join(mult, "definition")


def definition_gates(table: DataFrame, base: str, wider: str, mu: float, multiplier: float, tolerance: float = 0.02,
                     growth: float = 1.05) -> DataFrame:
    """A-28, acceptance: the base definition must reproduce the published figures and the
    wider one must enlarge the sample. Returns the broken gates; empty means accepted."""
    row = table.agg(
        F.max(F.when(F.col("definition") == base, F.col("mu"))).alias("mu"),
        F.max(F.when(F.col("definition") == base, F.col("multiplier"))).alias("multiplier"),
        F.max(F.when(F.col("definition") == base, F.col("total_n_eff"))).alias("n_base"),
        F.max(F.when(F.col("definition") == wider, F.col("total_n_eff"))).alias("n_wide"),
    )
    off = (F.abs(F.col("mu") - mu) > tolerance) | (F.abs(F.col("multiplier") - multiplier) > 2 * tolerance)
    gates = F.array(
        F.struct(F.lit("figures not reproduced").alias("gate"), F.coalesce(off, F.lit(True)).alias("broken")),
        F.struct(F.lit("wider definition adds nothing").alias("gate"),
                 F.coalesce(F.col("n_wide") <= F.col("n_base") * growth, F.lit(True)).alias("broken")),
    )
    return row.select(F.explode(gates).alias("g")).filter("g.broken").select("g.gate")


def scope_scan(cells: DataFrame, years: Sequence[int]) -> DataFrame:
    """A-29: change of the pooled mean, in percentage points, when only some years are kept."""
    def mean_of(scope: DataFrame, name: str) -> DataFrame:
        rated = effective(pool_cells(scope.filter(F.col("area") != ALL_AREAS), ["category", "area"]))
        size = rated.groupBy("category").agg(F.sum("n_eff").alias(f"n_{name}"))
        return fit_shrinkage(rated).select("category", F.col("mu").alias(f"mu_{name}")).join(size, "category")

    full = mean_of(cells, "full")
    part = mean_of(cells.filter(F.col("year").isin(list(years))), "scope")
    return full.join(part, "category").withColumn("delta_pp", 100.0 * (F.col("mu_scope") - F.col("mu_full")))
