"""Survey rates, shrinkage, surfaces, bounds and validation over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.operators import bounds as B
from tallyveil.operators import panel as P
from tallyveil.operators import rates as R
from tallyveil.operators import surface as S
from tallyveil.operators import validation as V
from tallyveil.operators.ranking import spearman_of_areas, with_p_value
from tallyveil.plans.catalog import AREA, CATEGORIES, YEARS, Tables, oracle, query
from tallyveil.session import cut_lineage, literal_rows

SUM_COLUMNS = "sw sw2 swd w_times w_times2 w_pnp w_any"
WILSON = """
  CASE WHEN n_eff > 0 THEN greatest(0.0, (p + 3.8416/(2*n_eff) - 1.96*sqrt(p*(1-p)/n_eff + 3.8416/(4*n_eff*n_eff))) / (1 + 3.8416/n_eff)) ELSE 0.0 END AS ci_low,
  CASE WHEN n_eff > 0 THEN least(1.0, (p + 3.8416/(2*n_eff) + 1.96*sqrt(p*(1-p)/n_eff + 3.8416/(4*n_eff*n_eff))) / (1 + 3.8416/n_eff)) ELSE 1.0 END AS ci_high"""


@query("a01_weighted_cells", oracle("SELECT * FROM cells", "cells", ints="year n", dbl=SUM_COLUMNS))
def _(t: Tables):
    return t.cells()


@query("a02_effective_size", oracle(
    "SELECT year, category, area, sw*sw/sw2 AS n_eff, swd/sw AS p, swd/sw*(sw*sw/sw2) AS y_eff FROM cells", "cells",
    ints="year", dbl="n_eff p y_eff"))
def _(t):
    return R.effective(t.cells()).select("year", "category", "area", "n_eff", "p", "y_eff")


@query("a03_effective_size_events", oracle(
    "SELECT year, category, area, w_times*w_times/w_times2 AS n_eff, w_pnp/w_times AS p, w_pnp/w_times*(w_times*w_times/w_times2) AS y_eff FROM cells",
    "cells", ints="year", dbl="n_eff p y_eff"))
def _(t):
    return R.effective(t.cells(), "incident").select("year", "category", "area", "n_eff", "p", "y_eff")


@query("a04_wilson_interval", oracle(f"SELECT category, area, p, {WILSON} FROM pooled", "pooled", dbl="p ci_low ci_high"))
def _(t):
    low, high = R.wilson(F.col("p"), F.col("n_eff"))
    return t.pooled().select("category", "area", "p", low.alias("ci_low"), high.alias("ci_high"))


DIRECT = """
direct AS (
  SELECT *, sw*sw/sw2 AS n_eff, swd/sw AS p FROM (
    SELECT category, year, CASE WHEN area = '_NAC' THEN 'NAC' ELSE 'LIMA' END AS scope, sum(sw) AS sw, sum(sw2) AS sw2, sum(swd) AS swd,
      sum(w_times) AS w_times, sum(w_pnp) AS w_pnp, sum(n) AS n
    FROM cells WHERE area = '_NAC' OR starts_with(area, '01') GROUP BY ALL) AS s)"""


@query("a05_direct_rates", oracle(
    f"SELECT category, year, scope, p AS rate, {WILSON}, w_pnp / w_times AS event_rate, n_eff, n FROM direct", "cells", DIRECT,
    ints="year n", dbl="rate ci_low ci_high event_rate n_eff"))
def _(t):
    return R.direct_rates(t.cells(), "01")


@query("a06_dispersion_share", oracle(
    "SELECT count(*) AS cells, avg(CASE WHEN sw*sw/sw2 >= 10 THEN 1.0 ELSE 0.0 END) AS share_10, avg(CASE WHEN sw*sw/sw2 >= 30 THEN 1.0 ELSE 0.0 END) AS share_30 FROM cells WHERE area <> '_NAC'",
    "cells", ints="cells", dbl="share_10 share_30"))
def _(t):
    return R.dispersion(t.cells())


@query("a07_sparsity_rule", oracle(
    "SELECT count(*) AS cells, median(n_eff) AS median_n_eff, max(n_eff) AS max_n_eff, 100.0*avg(CASE WHEN n_eff >= 30 THEN 1.0 ELSE 0.0 END) AS pct_large, CASE WHEN 100.0*avg(CASE WHEN n_eff >= 30 THEN 1.0 ELSE 0.0 END) >= 70 THEN 'A' ELSE 'B' END AS estimator FROM pooled",
    "pooled", ints="cells", dbl="median_n_eff max_n_eff pct_large"))
def _(t):
    return R.sparsity_rule(t.cells())


@query("a08_pooled_by_scope", oracle("""
  SELECT category, area, CASE WHEN category <> 'R' THEN 'panel' ELSE 'latest' END AS scope, sum(sw) AS sw, sum(sw2) AS sw2, sum(swd) AS swd,
    sum(w_times) AS w_times, sum(w_times2) AS w_times2, sum(w_pnp) AS w_pnp, sum(w_any) AS w_any, sum(n) AS n
  FROM cells WHERE area <> '_NAC' AND (category <> 'R' OR year = 2001) GROUP BY category, area""", "cells", ints="n", dbl=SUM_COLUMNS))
def _(t):
    crosswalk = t.category_list().withColumn("panel", F.col("category") != "R")
    return R.pool_scoped(t.cells().filter(F.col("area") != R.ALL_AREAS), crosswalk, 2001)


GRID = [(m, p) for m in (0.3, 0.45, 0.5, 0.55, 0.7) for p in (2.0, 20.0, 100.0)]
GRID_SQL = ", ".join(f"({m}, {p})" for m, p in GRID)


def _lbeta(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"


@query("a09_beta_binomial_likelihood", oracle(f"""
  SELECT category, mu, phi, sum({_lbeta('mu*phi + y_eff', '(1-mu)*phi + n_eff - y_eff')} - {_lbeta('mu*phi', '(1-mu)*phi')}) AS loglik, count(*) AS cells
  FROM pooled CROSS JOIN (VALUES {GRID_SQL}) AS g(mu, phi) WHERE n_eff > 0 GROUP BY category, mu, phi""",
    "pooled", ints="cells", dbl="mu phi loglik", digits=4), digits=4)
def _(t):
    grid = F.array(*[F.struct(F.lit(m).alias("mu"), F.lit(p).alias("phi")) for m, p in GRID])
    return R.likelihood_grid(t.pooled(), grid, ["category"])


@query("a10_shrinkage_fit")
def _(t):
    return R.fit_shrinkage(t.pooled())


@query("a11_posterior_mean", oracle(
    "SELECT category, area, n_eff, alpha, beta, alpha/(alpha+beta) AS r_hat FROM rated", "rated", dbl="n_eff alpha beta r_hat"))
def _(t):
    return t.rated().select("category", "area", "n_eff", "alpha", "beta", "r_hat")


def beta_cdf_sql(x: str, a: str, b: str, terms: int = 1500) -> str:
    """DuckDB expression of the regularised incomplete beta function, by its series of positive terms on the shorter side."""
    def side(x: str, a: str, b: str) -> str:
        term = f"exp(lgamma({a} + {b} + n) - lgamma({a} + 1 + n) - lgamma({b}) + ({a} + n) * ln({x}) + {b} * ln(1 - {x}))"
        return f"list_sum(list_transform(range({terms}), lambda n: {term}))"

    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {side(x, a, b)} ELSE 1 - {side(f'(1 - {x})', b, a)} END"


def beta_quantiles_sql(source: str) -> str:
    """CTE ``quantiles`` (a, b, p, q) for the distinct (a, b, p) of a select, by bisection."""
    return f"""
bisected AS (
  SELECT a, b, p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM (SELECT DISTINCT a, b, p FROM ({source}) AS s) AS d
  UNION ALL
  SELECT a, b, p, CASE WHEN reached < p THEN mid ELSE lo END, CASE WHEN reached < p THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, {beta_cdf_sql('mid', 'a', 'b')} AS reached FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisected WHERE i < 36) AS m) AS r),
quantiles AS (SELECT a, b, p, (lo + hi) / 2 AS q FROM bisected WHERE i = 36)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("a12_beta_interval", recursive(oracle(
    "SELECT category, area, a / (a + b) AS r_hat, l.q AS r_low, h.q AS r_high FROM beta JOIN quantiles l USING (a, b) JOIN quantiles h USING (a, b) WHERE l.p = 0.025 AND h.p = 0.975", "pooled",
    "beta AS (SELECT category, area, 0.5 * 40 + y_eff AS a, 0.5 * 40 + greatest(n_eff - y_eff, 0.0) AS b FROM pooled),"
    + beta_quantiles_sql("SELECT a, b, unnest([0.025, 0.975]) AS p FROM beta"), dbl="r_hat r_low r_high")))
def _(t):
    prior = t.category_list().withColumns({"mu": F.lit(0.5), "phi": F.lit(40.0)})
    return R.posterior(t.pooled(), prior, intervals=True).select("category", "area", "r_hat", "r_low", "r_high")


@query("a13_zero_rate_branch", oracle("""
  SELECT category, area, n_eff, CASE WHEN category = 'R' THEN 0.0 ELSE (0.5*40 + y_eff)/(40 + n_eff) END AS r_hat FROM pooled""",
    "pooled", dbl="n_eff r_hat"))
def _(t):
    prior = t.category_list().withColumns({"mu": F.when(F.col("category") == "R", 0.0).otherwise(0.5), "phi": F.lit(40.0)})
    return R.posterior(t.pooled(), prior).select("category", "area", "n_eff", "r_hat")


SURFACE = "area, category, year, observed, r_hat, latent, latent_low, latent_high, factor, latent_per_100k, unstable"


@query("a14_latent_surface", oracle(f"SELECT {SURFACE} FROM surface", "surface", ints="year observed unstable",
                                    dbl="r_hat latent latent_low latent_high factor latent_per_100k"))
def _(t):
    return t.surface().select(*[c.strip() for c in SURFACE.split(",")])


@query("a15_observed_counts", oracle("SELECT * FROM observed", "observed", ints="year observed"))
def _(t):
    return t.observed()


@query("a16_pooled_multiplier", oracle(
    "SELECT category, sum(observed) AS observed, sum(latent) AS latent, sum(latent)/greatest(sum(observed),1) AS multiplier, sum(observed) > 0 AND sum(latent)/sum(observed) > 20.0 AS unstable FROM surface GROUP BY category",
    "surface", ints="observed", dbl="latent multiplier"))
def _(t):
    return S.pooled_multiplier(t.surface())


@query("a17_area_multiplier", oracle(
    "SELECT area, sum(latent)/sum(observed) AS multiplier FROM surface GROUP BY area HAVING sum(observed) > 0", "surface", dbl="multiplier"))
def _(t):
    return S.area_multiplier(t.surface())


@query("a18_multiplier_band", oracle("""
  SELECT category, sum(latent)/sum(observed) AS multiplier, sum(coalesce(latent_low,0))/sum(observed) AS band_low,
    sum(coalesce(latent_high,0))/sum(observed) AS band_high, bool_or(latent_high IS NULL) AS truncated, bool_or(unstable = 1) AS unstable
  FROM surface GROUP BY category HAVING sum(observed) > 0""", "surface", dbl="multiplier band_low band_high"))
def _(t):
    return S.multiplier_band(t.surface())


@query("a19_jeffreys_interval", recursive(oracle(
    "SELECT category, k / size AS rate, l.q AS ci_low, h.q AS ci_high FROM jeffreys JOIN quantiles l USING (a, b) JOIN quantiles h USING (a, b) WHERE l.p < 0.5 AND h.p > 0.5", "cells",
    f"{DIRECT}, jeffreys AS (SELECT category, k, size, k + 0.5 AS a, size - k + 0.5 AS b FROM (SELECT category, sum(p * n_eff) AS k, sum(n_eff) AS size FROM direct WHERE scope = 'LIMA' GROUP BY category) AS s),"
    + beta_quantiles_sql("SELECT a, b, unnest([(1.0 - 0.8) / 2.0, 1.0 - (1.0 - 0.8) / 2.0]) AS p FROM jeffreys"), dbl="rate ci_low ci_high")))
def _(t):
    direct = R.direct_rates(t.cells(), "01").filter("scope = 'LIMA'")
    return R.jeffreys_pooled(direct, ["category"])


@query("a20_interval_reconstruction")
def _(t):
    prior = R.fit_shrinkage(t.pooled())
    rates = R.posterior(t.pooled(), prior, intervals=True)
    stored = rates.withColumns({c: F.round(c, 4) for c in ("r_hat", "r_low", "r_high")})
    return R.reconstruction_error(stored.select("category", "area", "n_eff", "phi", "r_hat", "r_low", "r_high"))


DELTA = """
  SELECT area, category, year, observed / r_hat AS latent,
    sqrt(observed*observed/power(r_hat,4) * (alpha*beta/((alpha+beta)*(alpha+beta)*(alpha+beta+1)))) AS sd_delta FROM surface"""


@query("a21_delta_deviation", oracle(DELTA, "surface", ints="year", dbl="latent sd_delta"))
def _(t):
    return S.delta_deviation(t.surface()).select("area", "category", "year", "latent", "sd_delta")


def _pooled_surface(t: Tables):
    return t.surface().groupBy("category", "area", "r_hat", "alpha", "beta").agg(F.sum("observed").alias("observed"))


@query("a22_monte_carlo_interval")
def _(t):
    return S.monte_carlo_interval(_pooled_surface(t))


@query("a23_near_floor_flag", oracle("""
  SELECT category, sum(latent)/sum(observed) AS point, sum(latent_low)/sum(observed) AS ci_low, sum(latent_high)/sum(observed) AS ci_high,
    sum(latent_low)/sum(observed) > sum(latent)/sum(observed) AS unstable_inversion FROM surface GROUP BY category""",
    "surface", dbl="point ci_low ci_high"))
def _(t):
    band = S.multiplier_band(t.surface())
    return S.near_floor(band.select("category", F.col("multiplier").alias("point"), F.col("band_low").alias("ci_low"), F.col("band_high").alias("ci_high")))


@query("a24_dispersion_test")
def _(t):
    return R.dispersion_test(t.pooled())


@query("a25_dispersion_bootstrap")
def _(t):
    return R.dispersion_bootstrap(t.pooled(), sims=400)


@query("a26_design_effect_scan")
def _(t):
    return R.design_effect_scan(t.pooled())


@query("a27_shrinkage_sweep")
def _(t):
    trust = t.customer.join(t.areas(), F.col("c_nationkey") == F.col("area_key")).groupBy("area").agg(F.avg("c_acctbal").alias("covariate"))
    return R.shrinkage_sweep(t.pooled(), trust)


@query("a28_definition_scan")
def _(t):
    observed = t.observed().filter("category = 'A'").groupBy("area").agg(F.sum("observed").alias("observed"))
    return R.definition_scan(t.cells(), observed, {"narrow": ["A"], "wide": ["A", "N"], "other": ["R"]})


@query("a29_scope_scan")
def _(t):
    return R.scope_scan(t.cells(), [1995, 1998, 1999, 2000, 2001])


FLAGS = f"""
raw AS (
  SELECT l_orderkey AS person, year(l_shipdate) AS year, l_returnflag AS category, {AREA} AS area, l_quantity AS weight,
      l_discount >= 0.04 AS victim, l_linestatus = 'F' AS reported
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
records AS (
  SELECT *, 'nacional' AS scope FROM raw UNION ALL SELECT *, 'lima' AS scope FROM raw WHERE starts_with(area, '0101') OR starts_with(area, '0202')),
scoped AS (
  SELECT scope, person, year, category, max(weight) AS weight, bool_or(victim) AS victim, bool_or(victim AND reported) AS reported FROM records GROUP BY ALL),
people AS (SELECT scope, person, year, max(weight) AS weight FROM records GROUP BY ALL),
base AS (
  SELECT scope, d.category AS category, sum(weight) AS w_base FROM people s
  JOIN (SELECT 'A' AS category, unnest(range(1995, 2002)) AS year UNION ALL SELECT 'N', unnest(range(1995, 2002)) UNION ALL SELECT 'R', 2001) AS d
    ON d.year = s.year GROUP BY ALL),
prev AS (
  SELECT *, w_x/w_base AS px, w_rx/w_base AS prx, w_rx/w_x AS rate, w_rx/w_x AS p, w_x*w_x/sw2 AS n_eff FROM (
    SELECT scope, category, sum(CASE WHEN victim THEN weight END) AS w_x, sum(CASE WHEN victim THEN weight*weight END) AS sw2,
      coalesce(sum(CASE WHEN reported THEN weight END), 0) AS w_rx, count(*) FILTER (WHERE victim) AS n_x FROM scoped GROUP BY scope, category) AS s
  JOIN base USING (scope, category)),
bounds AS (
  SELECT *, prx/(px+h) AS low, least(1.0, (prx+h)/(px+h)) AS high,
    CASE WHEN px + 2*rate*h - h <= 0 OR px - h <= 2*prx THEN least(1.0, (prx+h)/(px+h))
      ELSE greatest(least(1.0, (prx + rate*h)/(px + 2*rate*h - h)), prx/(px+h)) END AS mono_high
  FROM (SELECT p.*, nu, 1.0 - nu AS h FROM prev p CROSS JOIN (VALUES (1.0::DOUBLE), (0.995), (0.99), (0.975), (0.95), (0.90)) AS g(nu)) AS x)"""


def _flags(t: Tables):
    place = t.supplier.join(t.areas(), F.col("s_nationkey") == F.col("area_key")).select("s_suppkey", "area")
    rows = t.lineitem.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("person"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("category"), "area",
        F.col("l_quantity").alias("weight"), (F.col("l_discount") >= 0.04).alias("victim"), (F.col("l_linestatus") == "F").alias("reported"),
    )
    return B.scope_rows(rows, F.col("area"), ["0101", "0202"], "lima")


def _prevalence(t: Tables):
    records = _flags(t)
    # The base counts a person once in each scope and year, whatever was reported.
    people = records.groupBy("scope", "person", "year").agg(F.max("weight").alias("weight"))
    return B.prevalence(B.person_flags(records, ["scope", "person", "year"]), people, {"A": YEARS, "N": YEARS, "R": [2001]})


@query("a30_person_prevalence", oracle(
    f"SELECT scope, category, px, prx, rate, n_eff, n_x, {WILSON} FROM prev", "", FLAGS, ints="n_x", dbl="px prx rate n_eff ci_low ci_high"))
def _(t):
    return _prevalence(t).select("scope", "category", "px", "prx", "rate", "n_eff", "n_x", "ci_low", "ci_high")


@query("a31_worst_case_bounds", oracle("SELECT scope, category, nu, low, high FROM bounds", "", FLAGS, dbl="nu low high"))
def _(t):
    return B.bounds_table(_prevalence(t)).select("scope", "category", "nu", "low", "high")


@query("a32_monotone_bounds", oracle("SELECT scope, category, nu, low AS mono_low, mono_high FROM bounds", "", FLAGS, dbl="nu mono_low mono_high"))
def _(t):
    return B.bounds_table(_prevalence(t)).select("scope", "category", "nu", "mono_low", "mono_high")


@query("a33_collapse_threshold", oracle(
    "SELECT scope, category, max(CASE WHEN nu < 1 AND low > 0 AND high / nullif(low, 0) >= 1.2 THEN nu END) AS nu_collapse FROM bounds GROUP BY scope, category",
    "", FLAGS, dbl="nu_collapse"))
def _(t):
    return B.collapse_threshold(B.bounds_table(_prevalence(t)), ["scope", "category"], 1.2)


@query("a34_response_share", oracle("""
  SELECT area, sum(CASE WHEN a IN ('3','4') THEN w ELSE 0 END)/sum(w) AS share, count(*) AS respondents FROM (
    SELECT area, CAST(l_linenumber AS VARCHAR) AS a, coalesce(try_cast(replace(CAST(l_quantity AS VARCHAR), '.', '.') AS DOUBLE), 0) AS w
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN areas ON s_nationkey = area_key) AS r
  WHERE a IN ('1','2','3','4') GROUP BY area HAVING sum(w) > 0""", "areas", ints="respondents", dbl="share"))
def _(t):
    place = t.supplier.join(t.areas(), F.col("s_nationkey") == F.col("area_key")).select("s_suppkey", "area")
    answers = t.lineitem.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "area", F.col("l_linenumber").cast("string").alias("answer"), F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")).alias("w"))
    return V.response_share(answers, "answer", "w")


@query("a35_wave_counts", oracle(
    "SELECT category, count(DISTINCT CASE WHEN sw > 0 THEN year END) AS waves FROM cells GROUP BY category", "cells", ints="waves"))
def _(t):
    return V.wave_counts(t.cells())


COMPOSITION = """
comp AS (
  SELECT s.category, o.observed, o.latent, s.survey, s.waves, s.survey / s.waves AS annual FROM (
    SELECT category, sum(sw) AS survey, count(DISTINCT CASE WHEN sw > 0 THEN year END) AS waves FROM cells
    WHERE area <> '_NAC' AND (category <> 'R' OR year < 2000) GROUP BY category) AS s
  JOIN (SELECT category, CAST(sum(observed) AS DOUBLE) AS observed, sum(latent) AS latent FROM surface GROUP BY category) AS o USING (category)),
shares AS (
  SELECT category, waves, observed/sum(observed) OVER () AS share_observed, latent/sum(latent) OVER () AS share_latent,
    survey/sum(survey) OVER () AS share_survey, annual/sum(annual) OVER () AS share_annual FROM comp)"""
L1 = """SELECT sum(abs(share_observed-share_annual)) AS l1_observed_annual, sum(abs(share_latent-share_annual)) AS l1_latent_annual,
  sum(abs(share_observed-share_survey)) AS l1_observed_raw, sum(abs(share_latent-share_survey)) AS l1_latent_raw"""
L1_COLUMNS = "l1_observed_annual l1_latent_annual l1_observed_raw l1_latent_raw"


def _composition(t: Tables):
    cells = t.cells().filter((F.col("area") != R.ALL_AREAS) & ((F.col("category") != "R") | (F.col("year") < 2000)))
    survey = cells.groupBy("category").agg(F.sum("sw").alias("survey")).join(V.wave_counts(cells), "category")
    totals = t.surface().groupBy("category").agg(F.sum("observed").cast("double").alias("observed"), F.sum("latent").alias("latent"))
    return V.composition_table(totals, survey)


@query("a36_composition_distance", oracle(f"{L1} FROM shares", "cells surface", COMPOSITION, dbl=L1_COLUMNS))
def _(t):
    return V.l1_distances(_composition(t))


@query("a37_comparable_subset", oracle(f"""{L1} FROM (
    SELECT share_observed/sum(share_observed) OVER () AS share_observed, share_latent/sum(share_latent) OVER () AS share_latent,
      share_survey/sum(share_survey) OVER () AS share_survey, share_annual/sum(share_annual) OVER () AS share_annual FROM shares WHERE category <> 'N') AS k""",
    "cells surface", COMPOSITION, dbl=L1_COLUMNS))
def _(t):
    return V.l1_distances(V.renormalise(_composition(t), ["A", "R"]))


@query("a38_person_years", oracle("SELECT area, sum(population) AS person_years FROM population GROUP BY area", "population", ints="person_years"))
def _(t):
    return V.person_years(t.population())


AREA_TABLE = """
py AS (SELECT area, sum(population) AS person_years FROM population GROUP BY area),
area_table AS (
  SELECT s.category, s.area, s.observed, s.latent, p.sw AS survey, py.person_years, s.observed*1.0/py.person_years AS o, s.latent/py.person_years AS l, p.sw/py.person_years AS v
  FROM (SELECT category, area, sum(observed) AS observed, sum(latent) AS latent FROM surface GROUP BY ALL) AS s
  JOIN pooled p USING (category, area) JOIN py ON py.area = s.area),
both_levels AS (
  SELECT * FROM area_table UNION ALL
  SELECT 'TOTAL', area, sum(observed), sum(latent), sum(survey), any_value(person_years), sum(observed)*1.0/any_value(person_years),
    sum(latent)/any_value(person_years), sum(survey)/any_value(person_years) FROM area_table WHERE category <> 'R' GROUP BY area)"""


def _rank(c: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


def _rho(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"


def _area_table(t: Tables):
    s = t.surface().groupBy("category", "area").agg(F.sum("observed").alias("observed"), F.sum("latent").alias("latent"))
    d = s.join(t.pooled().select("category", "area", F.col("sw").alias("survey")), ["category", "area"])
    return d.join(V.person_years(t.population()), "area")


@query("a39_concordance_audit", oracle(f"""
  SELECT *, rho_latent - rho_observed AS delta FROM (
    SELECT category, {_rho('ro', 'rs')} AS rho_counts, {_rho('rro', 'rrv')} AS rho_observed, {_rho('rrl', 'rrv')} AS rho_latent, {_rho('rp', 'ro')} AS rho_population FROM (
      SELECT category, {_rank('observed', 'category')} AS ro, {_rank('survey', 'category')} AS rs, {_rank('o', 'category')} AS rro,
        {_rank('l', 'category')} AS rrl, {_rank('v', 'category')} AS rrv, {_rank('person_years', 'category')} AS rp FROM both_levels) AS k GROUP BY category) AS c""",
    "surface pooled population", AREA_TABLE, dbl="rho_counts rho_observed rho_latent rho_population delta"))
def _(t):
    d = _area_table(t)
    total = d.filter("category <> 'R'").groupBy("area", "person_years").agg(
        F.sum("observed").alias("observed"), F.sum("latent").alias("latent"), F.sum("survey").alias("survey")).withColumn("category", F.lit("TOTAL"))
    return V.concordance_audit(d.unionByName(total))


ANCHOR = """
grid AS (
  SELECT a.area, y.year AS year, k.category AS category FROM areas a CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) AS y CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS k(category)),
filled AS (
  SELECT g.area, g.year, g.category, coalesce(s.observed, 0) AS observed, coalesce(s.latent, 0.0) AS latent
  FROM grid g LEFT JOIN surface s ON s.area = g.area AND s.year = g.year AND s.category = g.category),
levels AS (
  SELECT area, year, category, observed, latent FROM filled UNION ALL
  SELECT area, year, 'TOTAL', sum(observed), sum(latent) FROM filled GROUP BY area, year),
anchor AS (
  SELECT area, year(l_shipdate) AS year, count(*) AS anchor_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN areas ON s_nationkey = area_key
  WHERE l_quantity >= 45 GROUP BY ALL),
anchored AS (
  SELECT l.*, p.population, coalesce(a.anchor_count, 0) AS anchor_count, coalesce(a.anchor_count, 0) * 1e5 / p.population AS anchor_rate,
    l.observed / p.population * 1e5 AS observed_rate, l.latent / p.population * 1e5 AS latent_rate
  FROM levels l JOIN population p ON p.area = l.area AND p.year = l.year LEFT JOIN anchor a ON a.area = l.area AND a.year = l.year),
scopes AS (SELECT *, CAST(year AS VARCHAR) AS scope FROM anchored UNION ALL SELECT *, 'pooled' AS scope FROM anchored),
anchor_rho AS (
  SELECT *, rho_latent - rho_observed AS delta FROM (
    SELECT scope, category, count(*) AS n, {rho_o} AS rho_observed, {rho_l} AS rho_latent, {rho_c} AS rho_observed_counts, {rho_p} AS rho_population, {rho_cc} AS rho_countcount FROM (
      SELECT scope, category, {r_ar} AS ar, {r_or} AS orr, {r_lr} AS lr, {r_o} AS o, {r_p} AS p, {r_ac} AS ac FROM scopes) AS k GROUP BY scope, category) AS c)""".format(
    rho_o=_rho("ar", "orr"), rho_l=_rho("ar", "lr"), rho_c=_rho("ar", "o"), rho_p=_rho("p", "o"), rho_cc=_rho("ac", "o"),
    r_ar=_rank("anchor_rate", "scope, category"), r_or=_rank("observed_rate", "scope, category"), r_lr=_rank("latent_rate", "scope, category"),
    r_o=_rank("observed", "scope, category"), r_p=_rank("population", "scope, category"), r_ac=_rank("anchor_count", "scope, category"))
ANCHOR_RHO = "rho_observed rho_latent rho_observed_counts rho_population rho_countcount delta"


def _dense_surface(t: Tables):
    grid = P.dense_panel(t.areas().select("area"), YEARS, CATEGORIES)
    s = t.surface().select("area", "year", "category", "observed", "latent")
    return grid.join(s, ["area", "year", "category"], "left").fillna({"observed": 0, "latent": 0.0})


def _anchored(t: Tables):
    levels = V.with_total(_dense_surface(t), ["area", "year"], ["observed", "latent"])
    place = t.supplier.join(t.areas(), F.col("s_nationkey") == F.col("area_key")).select("s_suppkey", "area")
    anchor = t.lineitem.filter("l_quantity >= 45").join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "area", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("anchor_count"))
    d = levels.join(t.population(), ["area", "year"]).join(anchor, ["area", "year"], "left").fillna({"anchor_count": 0})
    return d.withColumn("anchor_rate", F.col("anchor_count") * 1e5 / F.col("population"))


@query("a40_external_anchor_grid", oracle("SELECT * FROM anchor_rho", "surface", ANCHOR, ints="n", dbl=ANCHOR_RHO))
def _(t):
    return V.anchor_grid(_anchored(t))


@query("a41_anchor_wins", oracle(
    "SELECT category, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta IS NOT NULL) AS defined FROM (SELECT category, round(delta, 9) AS delta FROM anchor_rho) AS w GROUP BY category",
    "surface", ANCHOR, ints="wins defined"))
def _(t):
    return V.wins(V.anchor_grid(_anchored(t)).withColumn("delta", F.round("delta", 9)))


@query("a42_yearly_summary", oracle(
    "SELECT year, sum(observed) AS observed_sum, avg(observed) AS observed_mean, sum(latent) AS latent_sum, avg(latent) AS latent_mean FROM surface GROUP BY year",
    "surface", ints="year observed_sum", dbl="observed_mean latent_sum latent_mean"))
def _(t):
    return V.yearly_summary(t.surface(), ["observed", "latent"])


SCALES, REPS = [25, 24, 12, 6, 3, 1], 200
from tallyveil.functions.hashing import mixed_hash_sql  # noqa: E402

ZONES = f"""
zones AS (
  SELECT area, k, rep, (row_number() OVER (PARTITION BY k, rep ORDER BY {mixed_hash_sql('area_key', 'rep * 1009 + k')}, area_key) - 1) % k AS zone
  FROM areas CROSS JOIN (VALUES (25), (24), (12), (6), (3), (1)) AS s(k) CROSS JOIN (SELECT unnest(range(0, {REPS})) AS rep) AS r),
mass AS (
  SELECT s.area, s.category, CAST(s.observed AS DOUBLE) AS observed, s.latent, p.sw / w.waves AS annual
  FROM (SELECT category, area, sum(observed) AS observed, sum(latent) AS latent FROM surface GROUP BY ALL) AS s JOIN pooled p USING (category, area)
  JOIN (SELECT category, count(DISTINCT year) AS waves FROM cells WHERE area <> '_NAC' AND sw > 0 GROUP BY category) AS w ON w.category = s.category),
zone_mass AS (
  SELECT k, rep, zone, category, sum(observed) AS o, sum(latent) AS l, sum(annual) AS v FROM zones JOIN mass USING (area) GROUP BY ALL),
zone_share AS (
  SELECT *, sum(o) OVER z AS so, sum(l) OVER z AS sl, sum(v) OVER z AS sv FROM zone_mass WINDOW z AS (PARTITION BY k, rep, zone)),
zone_l1 AS (
  SELECT k, rep, zone, sv, sum(CASE WHEN so > 0 AND sv > 0 THEN abs(o/so - v/sv) END) AS lo, sum(CASE WHEN sl > 0 AND sv > 0 THEN abs(l/sl - v/sv) END) AS ll
  FROM zone_share GROUP BY ALL),
distances AS (
  SELECT k, rep, sum(CASE WHEN lo IS NOT NULL THEN sv*lo END)/sum(CASE WHEN lo IS NOT NULL THEN sv END) AS l1_observed,
    sum(CASE WHEN ll IS NOT NULL THEN sv*ll END)/sum(CASE WHEN ll IS NOT NULL THEN sv END) AS l1_latent FROM zone_l1 GROUP BY k, rep),
zone_total AS (SELECT k, rep, zone, sum(o) AS o, sum(l) AS l, sum(v) AS v FROM zone_mass GROUP BY ALL),
zone_rho AS (
  SELECT k, rep, {_rho('ro', 'rv')} AS rho_observed, {_rho('rl', 'rv')} AS rho_latent FROM (
    SELECT k, rep, {_rank('round(o, 6)', 'k, rep')} AS ro, {_rank('round(l, 6)', 'k, rep')} AS rl, {_rank('round(v, 6)', 'k, rep')} AS rv FROM zone_total) AS r GROUP BY k, rep)"""


def _zones(t: Tables):
    return V.rezone(t.areas(), SCALES, REPS)


def _mass(t: Tables):
    waves = V.wave_counts(t.cells().filter(F.col("area") != R.ALL_AREAS))
    return _area_table(t).join(waves, "category").select(
        "area", "category", F.col("observed").cast("double").alias("observed"), "latent", (F.col("survey") / F.col("waves")).alias("annual"))


@query("a43_random_rezoning", oracle("SELECT area, k, rep, zone FROM zones", "areas surface pooled", ZONES, ints="k rep zone"))
def _(t):
    return _zones(t)


@query("a44_zone_distance", oracle("SELECT * FROM distances", "areas surface pooled", ZONES, ints="k rep", dbl="l1_observed l1_latent"))
def _(t):
    return V.zone_distances(_zones(t), _mass(t))




@query("a45_zone_correlation", oracle("SELECT * FROM zone_rho", "areas surface pooled", ZONES, ints="k rep", dbl="rho_observed rho_latent"))
def _(t):
    return V.zone_correlations(_zones(t), _mass(t))


@query("a46_scale_sweep", oracle("""
  SELECT d.k AS k, count(*) AS reps, avg(l1_observed) AS l1_observed_mean, avg(l1_latent) AS l1_latent_mean, stddev_pop(l1_observed) AS l1_observed_sd,
    stddev_pop(l1_latent) AS l1_latent_sd, avg(r.rho_observed) AS rho_observed, avg(r.rho_latent) AS rho_latent,
    avg(CASE WHEN l1_latent < l1_observed THEN 1.0 ELSE 0.0 END) AS share_latent_closer
  FROM distances d LEFT JOIN (SELECT * FROM zone_rho WHERE k >= 12) AS r ON r.k = d.k AND r.rep = d.rep GROUP BY d.k""",
    "areas surface pooled", ZONES, ints="k reps",
    dbl="l1_observed_mean l1_latent_mean l1_observed_sd l1_latent_sd rho_observed rho_latent share_latent_closer"))
def _(t):
    mass = cut_lineage(_mass(t))  # areas x categories, used by both parts
    return V.scale_sweep(V.zone_distances(_zones(t), mass), V.zone_correlations(_zones(t), mass))


@query("a47_availability_profile", oracle("""
  SELECT y.year, y.schema, c.category, y.rows, h.victims, h.local_victims FROM (SELECT year, schema, count(*) AS rows FROM answers GROUP BY ALL) AS y
  JOIN (VALUES ('classic', 'low'), ('classic', 'mid'), ('new', 'low'), ('new', 'mid'), ('new', 'high')) AS c(schema, category) ON c.schema = y.schema
  LEFT JOIN (SELECT year, category, count(*) FILTER (WHERE victim) AS victims, count(*) FILTER (WHERE victim AND starts_with(area, '01')) AS local_victims
    FROM (SELECT *, CASE WHEN subtype IN (1, 2) THEN 'low' WHEN subtype IN (3, 4) AND schema = 'classic' OR subtype = 5 AND schema = 'new' THEN 'mid' END AS category FROM answers) AS q
    GROUP BY ALL) AS h ON h.year = y.year AND h.category = c.category""", "areas", f"""
  answers AS (SELECT year(l_shipdate) AS year, CASE WHEN year(l_shipdate) < 2001 THEN 'classic' ELSE 'new' END AS schema, area, l_linenumber AS subtype, l_linestatus = 'F' AS victim
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN areas ON s_nationkey = area_key)""", ints="year rows victims local_victims"))
def _(t):
    place = t.supplier.join(t.areas(), F.col("s_nationkey") == F.col("area_key")).select("s_suppkey", "area")
    answers = t.lineitem.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.year("l_shipdate").alias("year"), F.when(F.year("l_shipdate") < 2001, "classic").otherwise("new").alias("schema"), "area",
        F.col("l_linenumber").alias("subtype"), (F.col("l_linestatus") == "F").alias("victim"))
    crosswalk = literal_rows(t.spark, 
        [("classic", "low", [1, 2]), ("classic", "mid", [3, 4]), ("new", "low", [1, 2]), ("new", "mid", [5]), ("new", "high", [])],
        "schema string, category string, codes array<int>")
    return V.availability_profile(answers, crosswalk, "01")


@query("a48_registry_shares", oracle(
    "SELECT o_orderpriority AS category, count(*) AS total, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM orders GROUP BY o_orderpriority",
    ints="total", dbl="share"))
def _(t):
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("count"))
    return V.category_shares(counts)


@query("a49_rate_maps", oracle("""
  SELECT s.area, o/py*1e5 AS observed_rate, l/py*1e5 AS latent_rate, l/py*1e5 - o/py*1e5 AS gap
  FROM (SELECT area, sum(observed) AS o, sum(latent) AS l FROM surface GROUP BY area) AS s
  JOIN (SELECT area, sum(population) AS py FROM population GROUP BY area) AS p ON p.area = s.area""", "surface population",
    dbl="observed_rate latent_rate gap"))
def _(t):
    return S.rate_map(t.surface(), V.person_years(t.population()))


@query("a50_linear_trend", oracle(
    "SELECT category, regr_slope(observed, year) AS slope, regr_intercept(observed, year) AS intercept FROM observed GROUP BY category",
    "observed", dbl="slope intercept", digits=4), digits=4)
def _(t):
    return V.linear_trend(t.observed(), ["category"], "year", "observed")


@query("m03_spearman_p_value", oracle(f"""
  SELECT category, rho, n, CASE WHEN rho IS NULL OR n < 3 THEN NULL WHEN abs(rho) >= 1 THEN 0.0 ELSE {beta_cdf_sql('x', '(dof / 2)', '0.5::DOUBLE')} END AS p_value FROM (
    SELECT *, dof / (dof + rho * rho * dof / (1 - rho * rho)) AS x FROM (
      SELECT category, {_rho('ro', 'rs')} AS rho, count(*) AS n, greatest(count(*) - 2, 1)::DOUBLE AS dof FROM (
        SELECT category, {_rank('observed', 'category')} AS ro, {_rank('survey', 'category')} AS rs FROM area_table) AS k GROUP BY category) AS c) AS d""",
    "surface pooled population", AREA_TABLE, ints="n", dbl="rho p_value"))
def _(t):
    return with_p_value(spearman_of_areas(_area_table(t), ["category"], "observed", "survey"))
