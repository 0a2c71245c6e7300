"""Rates, shrinkage, bounds and surfaces: published values and brute force."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.operators import bounds as B
from tallyveil.operators import rates as R
from tallyveil.operators import surface as S
from tallyveil.operators import validation as V
from tallyveil.operators.screening import agreement


def test_unknown_area_feeds_only_the_total(spark):
    rows = [(2020, "x", "010101", 2.0, 1, 1, 1, 1), (2020, "x", None, 3.0, 2, 0, 0, 1)]
    d = spark.createDataFrame(rows, "year int, category string, area string, weight double, times int, pnp int, pnp_count int, any_count int")
    got = {r["area"]: r for r in R.weighted_cells(d).collect()}
    assert set(got) == {"010101", "_NAC"}
    assert (got["_NAC"]["sw"], got["_NAC"]["sw2"], got["_NAC"]["swd"], got["_NAC"]["w_times"], got["_NAC"]["n"]) == (5.0, 13.0, 2.0, 8.0, 2)


def test_wilson_published(spark):
    d = spark.createDataFrame([(0.5, 100.0), (0.3, 0.0)], "p double, n double")
    low, high = R.wilson(F.col("p"), F.col("n"))
    rows = d.select(low, high).collect()
    assert rows[0][0] == pytest.approx(0.4038, abs=1e-4) and rows[0][1] == pytest.approx(0.5962, abs=1e-4)
    assert tuple(rows[1]) == (0.0, 1.0)


def loglik(y, n, mu, phi):
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    a, b = mu * phi, (1 - mu) * phi
    return sum(lb(a + v, b + m - v) - lb(a, b) for v, m in zip(y, n))


def test_shrinkage_fit_reaches_the_maximum(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(20, 200, 30)
    y = rng.binomial(n, rng.beta(6, 14, 30))
    d = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(y, n)], "category string, y_eff double, n_eff double")
    got = R.fit_shrinkage(d, cap=None).first()
    best = max(loglik(y, n, m, p) for m in np.linspace(0.25, 0.36, 56) for p in np.exp(np.linspace(1, 5, 81)))
    assert got["loglik"] >= best - 1e-3
    assert loglik(y, n, got["mu"], got["phi"]) == pytest.approx(got["loglik"], abs=1e-6)


def test_shrinkage_fallbacks(spark):
    rows = [("few", 3.0, 10.0), ("few", 1.0, 10.0), ("none", 0.0, 5.0), ("none", 0.0, 5.0), ("none", 0.0, 5.0), ("cap", 50.0, 100.0), ("cap", 50.0, 100.0), ("cap", 50.0, 100.0)]
    d = spark.createDataFrame(rows, "category string, y_eff double, n_eff double")
    got = {r["category"]: r for r in R.fit_shrinkage(d).collect()}
    assert (got["few"]["mu"], got["few"]["phi"]) == (0.2, 1.0)
    assert (got["none"]["mu"], got["none"]["phi"]) == (0.0, 1.0)
    assert got["cap"]["mu"] == pytest.approx(0.5, abs=1e-3) and got["cap"]["phi"] == 100.0


def test_dispersion_test_separates(spark):
    rng = np.random.default_rng(5)
    n = np.full(40, 200)
    rows = [("same", f"{i:06d}", float(v), 200.0) for i, v in enumerate(rng.binomial(n, 0.3))]
    rows += [("mixed", f"{i:06d}", float(v), 200.0) for i, v in enumerate(rng.binomial(n, rng.beta(6, 14, 40)))]
    d = spark.createDataFrame(rows, "category string, area string, y_eff double, n_eff double")
    got = {r["category"]: r for r in R.dispersion_test(d).collect()}
    assert got["mixed"]["p_value"] < 1e-6 and got["mixed"]["lrt"] > 50 and got["mixed"]["phi_hat"] < 60
    assert got["same"]["p_value"] > 0.01 and got["same"]["p_boundary"] == got["same"]["p_value"] / 2
    boot = {r["category"]: r for r in R.dispersion_bootstrap(d, sims=19).collect()}
    assert boot["mixed"]["p_boot"] == pytest.approx(0.05) and boot["same"]["p_boot"] > 0.05


def test_bounds_published(spark):
    d = spark.createDataFrame([(0.10271, 0.10271 * 0.2179)], "px double, prx double")
    row = B.bounds_table(d).filter("nu = 0.99").first()
    assert row["low"] == pytest.approx(0.1985, abs=2e-4) and row["high"] == pytest.approx(0.2873, abs=2e-4)
    assert row["mono_high"] == pytest.approx(0.2530, abs=2e-4)
    rare = spark.createDataFrame([(0.0302, 0.0302 * 0.0141, "x")], "px double, prx double, category string")
    table = B.bounds_table(rare)
    at = table.filter("nu = 0.99").first()
    assert at["low"] == pytest.approx(0.0106, abs=1e-4) and at["high"] == pytest.approx(0.2593, abs=1e-3)
    assert B.collapse_threshold(table, ["category"]).first()["nu_collapse"] == 0.995


def test_kappa_published(spark):
    rows = [(1, 1)] * 40 + [(0, 1)] + [(0, 0)] * 3
    got = agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert got["chance"] == pytest.approx(0.8533, abs=1e-4) and got["kappa"] == pytest.approx(0.8451, abs=1e-4)


def test_inversion_flips_bounds_and_skips_zero_rates(spark):
    rows = [("a", "x", 2020, 10, 0.5, 0.0, 0.8, 1000), ("b", "x", 2020, 10, 0.0, 0.0, 0.1, 1000), ("c", "x", 2020, 10, None, None, None, None)]
    d = spark.createDataFrame(rows, "area string, category string, year int, observed long, r_hat double, r_low double, r_high double, population long")
    got = S.invert(d).collect()
    assert len(got) == 1 and got[0]["latent"] == 20.0 and got[0]["latent_low"] == 12.5 and got[0]["latent_high"] is None
    assert got[0]["latent_per_100k"] == 2000.0 and got[0]["factor"] == 2.0
    reasons = {r["area"]: r["reason"] for r in S.exclusion_reason(d).collect()}
    assert reasons == {"a": None, "b": "rate not usable", "c": "no rate"}
    band = S.multiplier_band(S.invert(d)).first()
    assert band["truncated"] and band["multiplier"] == 2.0 and band["band_low"] == 1.25


def test_monte_carlo_interval_is_repeatable_and_covers(spark):
    rows = [("k", f"{i:06d}", 100 + i, 30.0 + i, 70.0) for i in range(20)]
    d = spark.createDataFrame(rows, "category string, area string, observed long, alpha double, beta double").withColumn(
        "r_hat", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    a = S.monte_carlo_interval(d, draws=4000).first()
    b = S.monte_carlo_interval(d.repartition(7), draws=4000).first()
    assert tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-12) and a["areas"] == 20
    rng = np.random.default_rng(1)
    al, y = 30.0 + np.arange(20), 100 + np.arange(20)
    draws = (y / rng.beta(al, 70.0, (20000, 20))).sum(axis=1) / y.sum()
    lo, hi = np.percentile(draws, [2.5, 97.5])
    assert a["ci_low"] == pytest.approx(lo, rel=0.02) and a["ci_high"] == pytest.approx(hi, rel=0.02)


def test_surfaces_keep_district_totals(spark):
    cells = spark.createDataFrame([("c1", "d1", 10.0), ("c2", "d1", 30.0), ("c3", "d2", 0.0), ("c4", "d2", 0.0)], "cell string, district string, population double")
    w = S.population_weights(cells)
    assert {r["cell"]: r["weight"] for r in w.collect()} == {"c1": 0.25, "c2": 0.75, "c3": 0.5, "c4": 0.5}
    surface = spark.createDataFrame([("d1", 2020, "x", 100.0), ("d2", 2020, "x", 8.0)], "district string, year int, category string, latent double")
    points = spark.createDataFrame([("c1", "d1", 2020, "x", 6), ("c1", "d2", 2020, "x", 9), ("c1", "d1", 2020, "x", 3)],
                                   "cell string, district string, year int, category string, count int")
    out = S.hybrid_surface(w, surface, points, ["latent"], 10.0)
    assert out.count() == 4  # the border cell is not duplicated
    totals = {r["district"]: r["s"] for r in out.groupBy("district").agg(F.sum("latent").alias("s")).collect()}
    assert totals["d1"] == pytest.approx(100.0) and totals["d2"] == pytest.approx(8.0)
    c1 = out.filter("cell = 'c1'").first()
    assert c1["weight"] == pytest.approx((9 + 10 * 0.25) / 19)


def test_composition_distances(spark):
    rows = [("a", 60.0, 30.0, 600.0, 6), ("b", 40.0, 70.0, 500.0, 5)]
    d = spark.createDataFrame(rows, "category string, observed double, latent double, survey double, waves int")
    table = V.composition_table(d.select("category", "observed", "latent"), d.select("category", "survey", "waves"))
    got = V.l1_distances(table).first()
    assert got["l1_observed_annual"] == pytest.approx(0.2) and got["l1_latent_annual"] == pytest.approx(0.4)
    assert got["l1_observed_raw"] == pytest.approx(2 * abs(0.6 - 600 / 1100))


def test_definition_gates(spark):
    table = spark.createDataFrame([("base", 0.224, 4.63, 100.0), ("wide", 0.15, 6.0, 104.0)], "definition string, mu double, multiplier double, total_n_eff double")
    broken = lambda mu: [r["gate"] for r in R.definition_gates(table, "base", "wide", mu, 4.627).collect()]
    assert broken(0.224) == ["wider definition adds nothing"]
    assert broken(0.3) == ["figures not reproduced", "wider definition adds nothing"]


def test_rezoning_is_balanced(spark):
    areas = spark.range(43).select(F.col("id").alias("area_key"), F.format_string("%06d", "id").alias("area"))
    sizes = V.rezone(areas, [12], 5).groupBy("rep", "zone").count().collect()
    assert len(sizes) == 60 and {r["count"] for r in sizes} == {3, 4}


def test_questionnaire_edge_cases(spark):
    names = {"victim": "P601_{x}", "times": "P602_{x}", "any": "P602E_{x}", "count": "P602F_{x}_1_ENT", "reported": "P606_{x}", "where": "P607_{x}",
             "dep": "P602B_{x}", "prov": "P602C_{x}", "dist": "P602D_{x}_COD"}
    columns = "person int, FACTOR string, P601_1 string, P602_1 string, P602F_1_1_ENT string, P606_1 string, P607_1 string, P602B_1 string, P602C_1 string, P602D_1_COD string"
    rows = [(1, "2,5", "1", "51", "9", "1", "1", "15", "1", "7"), (2, "0", "1", "2", "1", "1", "1", "15", "1", "7"), (3, "1", "2", "2", "1", "1", "1", "15", "1", "7"),
            (4, "1", " 1 ", "3", "", "1", "2", "", "1", "7")]
    got = {r["person"]: r for r in R.unpivot_questionnaire(spark.createDataFrame(rows, columns), ["1"], names, "person", "FACTOR", 2019).collect()}
    assert set(got) == {1, 4}
    assert (got[1]["area"], got[1]["times"], got[1]["pnp"], got[1]["pnp_count"], got[1]["any_count"], got[1]["weight"]) == ("150107", 1, 1, 1, 1, 2.5)
    assert (got[4]["area"], got[4]["times"], got[4]["pnp"], got[4]["pnp_count"], got[4]["any_count"]) == (None, 3, 0, 0, 1)
    assert R.detect_questionnaire(["a", "p615_2"]) == "new" and R.detect_questionnaire(["P601_1"]) == "classic"


def test_registered_interval_draws_the_published_number(spark, monkeypatch):
    from tallyveil.plans import all_queries

    run, seen = S.monte_carlo_interval, []

    def noted(*args, **settings):
        call = inspect.signature(run).bind(*args, **settings)
        call.apply_defaults()
        seen.append(call.arguments["draws"])
        return args[0]

    monkeypatch.setattr(S, "monte_carlo_interval", noted)
    all_queries()["a22_monte_carlo_interval"](spark, "/root/testdata/sf0.001")
    assert seen == [200_000]


def test_direct_rates_compute_the_cells_once(spark, capsys):
    from tallyveil.plans import all_queries

    all_queries()["a05_direct_rates"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet [l_") == 1
    # The line items meet few suppliers where they are read, they are not shuffled for them.
    assert "SortMergeJoin" not in plan


def test_direct_rates_count_a_cell_in_every_scope_it_fits(spark):
    rows = [(2020, "x", a, w, 1, 1, 1, 1) for a, w in (("010101", 2.0), ("020101", 3.0), (None, 4.0))]
    d = spark.createDataFrame(rows, "year int, category string, area string, weight double, times int, pnp int, pnp_count int, any_count int")
    rated = {r["scope"]: r["n"] for r in R.direct_rates(R.weighted_cells(d), "01").collect()}
    assert rated == {"NAC": 3, "LIMA": 1}
    # An empty prefix fits the total row too.
    assert {r["scope"]: r["n"] for r in R.direct_rates(R.weighted_cells(d), "").collect()} == {"NAC": 3, "LIMA": 5}
