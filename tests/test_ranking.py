"""Rank kernels and resampling against brute force, with a group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyveil.operators import ranking as RK
from tallyveil.operators import resample as RS
from tallyveil.operators.ordering import average_ranks, exact_quantile, positions, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 4000
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcde"), n))
    x = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.random(n) * 50, 1))
    y = np.round(x * 0.3 + rng.random(n) * 20)
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "x": x, "y": y})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_running_totals_over_slices(skewed):
    pdf, df = skewed
    out = running_totals(df, ["g"], [F.col("x").desc(), F.col("id")], {"v": F.col("y")}).toPandas().sort_values("id")
    want = pdf.sort_values(["x", "id"], ascending=[False, True])
    want["run"] = want.groupby("g")["y"].cumsum()
    want = want.sort_values("id")
    assert np.allclose(out["run_v"].to_numpy(), want["run"].to_numpy())
    assert np.allclose(out["all_v"].to_numpy(), want.groupby("g")["y"].transform("sum").to_numpy())


def test_positions_without_keys_and_with_null_keys(skewed, spark):
    _, df = skewed
    got = positions(df, [], [F.col("id")]).agg(F.max("position"), F.count_distinct("position"), F.max("group_rows")).first()
    assert tuple(got) == (4000, 4000, 4000)
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    assert {(r["id"], r["position"], r["group_rows"]) for r in positions(d, ["g"], [F.col("id")]).collect()} == {(1, 1, 2), (2, 2, 2), (3, 1, 1)}


def test_average_ranks_and_spearman(skewed):
    pdf, df = skewed
    ranks = average_ranks(df, ["g"], "x").toPandas()
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).groupby(["g", "x"])["r"].first().reset_index()
    merged = ranks.merge(want, on=["g", "x"])
    assert len(merged) == len(want) and np.allclose(merged["rank"], merged["r"])
    got = {r["g"]: r["rho"] for r in RK.spearman(df, ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-10)
    same = {r["g"]: r["rho"] for r in RK.spearman_of_areas(df, ["g"], "x", "y").collect()}
    assert same == pytest.approx(got, abs=1e-10)


def test_guarded_spearman(spark):
    rows = [("short", 1.0, 2.0), ("short", 2.0, 3.0)] + [("flat", 1.0, float(i)) for i in range(5)] + [("nan", float("nan"), 1.0)] * 4
    got = {r["g"]: r["rho"] for r in RK.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got == {"short": None, "flat": None}


def test_exact_quantile(skewed):
    pdf, df = skewed
    got = {r["g"]: r["q"] for r in exact_quantile(df, ["g"], "x", 0.3, "q").collect()}
    assert got == pytest.approx(pdf.groupby("g")["x"].quantile(0.3).to_dict())


def test_top_share_rules(spark):
    rows = [("a", i, float(i), float(i % 3)) for i in range(25)]
    d = spark.createDataFrame(rows, "g string, cell int, pred double, target double")
    r = {rule: RK.top_share(d, ["g"], "pred", "target", "cell", rule).first()["k"] for rule in ("round", "ceil")}
    assert r == {"round": 2, "ceil": 3}  # 2.5 rounds to even, and up


def test_support_rule(spark):
    rows = [("few", i, float(i), float(i)) for i in range(4)] + [("ok", i, float(i), float(i)) for i in range(5)] + [("flat", i, 1.0, float(i)) for i in range(9)]
    d = spark.createDataFrame(rows, "district string, cell int, pred double, target double").withColumn("category", F.lit("k"))
    assert [r["district"] for r in RK.within_district(d, "pred").collect()] == ["ok"]


def test_perfect_ranking_scores(spark):
    d = spark.createDataFrame([("k", "d", i, float(i), float(i)) for i in range(20)], "category string, district string, cell int, pred double, target double")
    row = RK.metric_pack(d, "pred").first()
    assert row["ndcg"] == pytest.approx(1.0) and row["spearman_global"] == pytest.approx(1.0) and row["nmae"] == 0.0
    assert row["recall10"] == pytest.approx((19 + 18) / 190) and row["intra_pai"] == pytest.approx(row["intra_recall10"] / 0.1)
    assert RK.conservation_error(d, "pred").first()["error"] == 0.0
    assert RK.overlap_at_k(d, ["category"], "pred", "target", "cell").first()["overlap"] == 1.0


def test_bootstrap_matches_numpy_spread(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0.4, 0.2, 60)
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "category string, district int, rho double")
    a = RS.bootstrap_macro(d, "rho", replicates=800).first()
    # The same draws whatever the partitioning; only the order of additions may differ.
    assert tuple(a) == pytest.approx(tuple(RS.bootstrap_macro(d.repartition(5), "rho", replicates=800).first()), rel=1e-12)
    half = 1.96 * values.std() / np.sqrt(60)
    assert a["point"] == pytest.approx(values.mean()) and a["ci_high"] - a["ci_low"] == pytest.approx(2 * half, rel=0.15)


def test_paired_delta_needs_two_districts(spark):
    d = spark.createDataFrame([("one", 1, 0.1, 0.5), ("two", 1, 0.1, 0.2), ("two", 2, 0.3, 0.2)], "category string, district int, rho_a double, rho_b double")
    got = {r["category"]: r for r in RS.bootstrap_by_category(d, "rho", replicates=50).collect()}
    assert got["one"]["point"] is None and got["one"]["districts"] == 1
    assert got["two"]["point"] == pytest.approx(0.0) and got["two"]["ci_low"] <= got["two"]["ci_high"]


def test_replication_flags(spark):
    rows = [("positive", 0.01, 0.1, True, True), ("positive", -0.1, 0.1, False, False), ("ns", -0.1, 0.1, False, True), ("negative", -0.2, -0.1, True, True)]
    d = spark.createDataFrame(rows, "expected string, ci_low double, ci_high double, sig boolean, rep boolean")
    out = RS.replication(RS.significance(d), F.col("expected")).collect()
    assert all(r["significant"] == r["sig"] and r["replicates_expected"] == r["rep"] for r in out)


def test_placebo_keeps_totals(skewed):
    pdf, df = skewed
    out = RS.placebo_permutation(df, ["g"], "id", "y", 3).toPandas().sort_values("id")
    assert out.groupby("g")["placebo"].sum().to_dict() == pdf.groupby("g")["y"].sum().to_dict()
    hot = out[out["g"] == "hot"]["placebo"].to_numpy()
    assert abs(np.corrcoef(hot, pdf[pdf["g"] == "hot"]["y"])[0, 1]) < 0.1


def test_ladder_reference_moves_only_on_ladder_rows(spark):
    d = spark.createDataFrame([(1, 0.38, True), (2, 0.45, True), (3, 0.36, False), (4, 0.46, True)], "step int, score double, ladder boolean")
    got = [r["delta"] for r in RS.rolling_reference(d, "step", "score", "ladder").orderBy("step").collect()]
    assert got == [None, pytest.approx(0.07), None, pytest.approx(0.01)]


def test_contrasts_drop_missing_pairs(spark):
    rows = [("a", 1, 0.5), ("b", 1, 0.2), ("a", 2, float("nan")), ("b", 2, 0.1), ("a", 3, 0.4)]
    d = spark.createDataFrame(rows, "cell string, seed int, v double")
    assert [tuple(r) for r in RS.paired_contrast(d, "cell", "seed", "v", "a", "b").collect()] == [(1, pytest.approx(0.3))]
    assert {r["cell"]: r["n"] for r in RS.cell_summary(d, ["cell"], "v").collect()} == {"a": 2, "b": 2}


def test_bounded_and_sliced_groups_rank_alike(spark, monkeypatch):
    d = spark.range(900).select(
        F.when(F.col("id") % 90 != 0, F.concat(F.lit("g"), F.least(F.lit(4), F.col("id") % 10).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 31).cast("double").alias("x"), (F.col("id") * 104729 % 97 + F.col("id") % 31).cast("double").alias("y"))

    def found():
        return {r["g"]: (round(r["rho"], 12), r["n"]) for r in RK.spearman(d, ["g"], "x", "y").collect()}

    plain = found()
    sliced = []
    kernel = RK._sliced_spearman
    monkeypatch.setattr(RK, "_sliced_spearman", lambda pairs, keys, n: sliced.append(pairs.select("g").distinct().count()) or kernel(pairs, keys, n))
    monkeypatch.setattr(RK, "RANK_PAIRS", 100)
    assert found() == plain and len(plain) == 5 and sliced == [1]


def test_baselines_compute_their_rows_once_for_all_columns(spark):
    from tallyveil.operators.models import baselines

    rows = [(c, d, 10 * d + i, float((7 * i + d) % 5) if c == "a" else 0.0, float((3 * i) % 7), float((i * i + d) % 11)) for c in ("a", "b") for d in range(3) for i in range(8)]
    source = spark.createDataFrame(rows, "category string, district int, cell int, target double, old double, blend double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = baselines(source.mapInArrow(counted, source.schema), {"history": "old", "blend": "blend"})
    got = {r["model"]: r.asDict() for r in found.collect()}
    assert seen.value == len(rows)
    assert found.columns == [*RK.metric_pack(source, "old").columns, "model"]
    assert set(got) == {"history", "blend"}
    for name, c in (("history", "old"), ("blend", "blend")):
        (one,) = RK.metric_pack(source, c).collect()  # nothing happens in category b
        assert got[name] == pytest.approx(one.asDict() | {"model": name})
