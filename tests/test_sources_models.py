"""Readers, sinks, streaming and models."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.operators import boosting as B
from tallyveil.operators import models as M
from tallyveil.operators import panel as P
from tallyveil.sources import readers as RD
from tallyveil.sources import writers as WR
from tallyveil.streaming import cells as ST


def archive(path, text, name="WAVE_CAP_600.csv", nested=True):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, text.encode("latin-1"))
    if not nested:
        path.write_bytes(inner.getvalue())
        return
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/inner.zip", inner.getvalue())


def test_survey_archives(spark, tmp_path):
    archive(tmp_path / "a.zip", 'CCDD;FACTOR;P601_1\n15;32,5;"1;x"\n15;1\n07;2,0;2\x00\n')
    archive(tmp_path / "b.zip", "FACTOR|ÑU|CCDD\n3,5|é|15\n", nested=False)
    archive(tmp_path / "c.zip", "A,B\n1,2\n", name="other.csv")
    rows = RD.read_survey_archives(spark, str(tmp_path), ["CCDD", "FACTOR", "P601_1", "ÑU"])
    got = {tuple(r)[1:] for r in rows.collect()}
    explored = RD.complete_rows(RD.survey_rows(spark.read.format("binaryFile").load(str(tmp_path))))
    assert got == {tuple(r) for r in explored.select(*[RD.field(c) for c in rows.columns[1:]]).collect()}
    assert got == {("15", "32,5", "1;x", None), ("07", "2,0", "2", None), ("15", "3,5", None, "é")}


def test_survey_columns_are_pruned_and_complete(spark, tmp_path):
    archive(tmp_path / "a.zip", 'CCDD;FACTOR;P601_1\n15;32,5;"1;x"\n15;1\n07;2,0;2\n')
    archive(tmp_path / "b.zip", "factor|CCDD\n3,5|15\n", nested=False)
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    got = {tuple(r)[1:] for r in RD.survey_columns(binary, ["FACTOR", "P601_1"], batch=1).collect()}
    assert got == {("32,5", "1;x"), ("2,0", "2"), ("3,5", None)}


def test_simple_survey_and_typed_scan(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_bytes("ubigeo;FACTOR;año\n000101;1,5;2020\n".encode("latin-1"))
    row = RD.read_simple_survey(spark, str(f)).first()
    assert tuple(row) == ("000101", "1,5", "2020") and "año" in row.asDict()
    g = tmp_path / "t.csv"
    g.write_text("ubigeo,anio,homicidios\n000101,2020,x\n000102,2021,\n000103,2021,4\n")
    got = RD.read_typed_csv(spark, str(g), {"anio": "int", "homicidios": "int"}).orderBy("ubigeo").collect()
    assert [tuple(r) for r in got] == [("000101", 2020, 0), ("000102", 2021, 0), ("000103", 2021, 4)]


def test_multi_line_corpus(spark, tmp_path):
    f = tmp_path / "corpus.json"
    f.write_text('{"meta": {"query": "q"},\n "papers": [{"paperId": "a", "externalIds": {"DOI": "https://doi.org/10.1/X"}, "fieldsOfStudy": ["CS"]},\n {"paperId": "b", "citationCount": 3}]}')
    got = {r["paper"]: (r["doi"], r["field"], r["citations"], r["tldr"]) for r in RD.flatten_papers(RD.read_corpus(spark, str(f))).collect()}
    assert got == {"a": ("10.1/x", "CS", 0, ""), "b": ("", None, 3, "")}


def test_front_matter(spark, tmp_path):
    (tmp_path / "one.md").write_text('---\nkey: "k1"\ndoi: "https://doi.org/10.1/A"\nscreening: accepted\n---\nbody\nkey: other\n')
    (tmp_path / "two.md").write_text("---\ntitle: x\n---\n")
    (tmp_path / "three.md").write_text("key: k3\n---\n")
    got = {tuple(r) for r in RD.read_front_matter(spark, str(tmp_path)).collect()}
    assert got == {("k1", "10.1/a", "accepted"), ("two", "", "")}


def test_scan_pushes_filters_and_prunes(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # the plan text is cut otherwise
    d = RD.scan(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], {"l_linestatus": "F"}, {"l_linenumber": [1, 2]}, {"l_returnflag": ["A"]})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,F)" in plan and "In(l_linenumber, [1,2])" in plan and "Not(EqualTo(l_returnflag,A))" in plan
    assert "l_extendedprice" not in plan


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 2020, 1.5), ("b", 2021, None)], "area string, year int, value double")
    rows = {tuple(r) for r in d.collect()}
    back = RD.read_registry(spark, WR.write_csv(d, str(tmp_path / "c")), "area string, year int, value double")
    assert {tuple(r) for r in back.collect()} == rows
    one = spark.read.parquet(WR.write_surface(d, str(tmp_path / "p"))).filter("year = 2020")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert [r["area"] for r in one.collect()] == ["a"]
    path = WR.write_json(d, ["area"], str(tmp_path / "j"))
    nested = spark.read.json(path, schema="area string, values struct<year: int, value: double>")
    assert {tuple(r) for r in nested.select("area", "values.year", "values.value").collect()} == rows


def test_stream_equals_batch_with_open_windows(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 24} {i % 24:02d}:30:00", "k" if i % 3 else "l", float(i), i % 2) for i in range(96)]
    d = spark.createDataFrame(rows, "t string, category string, w double, r int").select(F.to_timestamp("t").alias("ts"), "category", "w", "r")
    d.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = ST.read_events(spark, str(tmp_path / "in"), d.schema, files_per_trigger=1)
    got = {tuple(r) for r in ST.drain(ST.windowed_cells(stream, "ts", "category", "w", "r", "1 day", "5 days"), ["start", "end", "category"]).collect()}
    batch = {tuple(r) for r in ST.windowed_cells(d, "ts", "category", "w", "r", "1 day", None).collect()}
    assert got == batch and len(batch) == 8
    d.limit(0).write.parquet(str(tmp_path / "none"))
    none = ST.read_events(spark, str(tmp_path / "none"), d.schema)
    assert ST.drain(ST.windowed_cells(none, "ts", "category", "w", "r", "1 day", "1 hour"), ["start", "end", "category"]).collect() == []


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random(n) * 10
    rows = [(i, f"d{i % 6}", 2000 + i % 3, "k", float(v), float(v * 2 if i % 7 else "nan"), float(rng.poisson(v))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "cell long, district string, year int, category string, a double, b double, target double").cache()


def test_medians_come_from_train_rows(spark, toy):
    train, test = toy.filter("year < 2002 AND a < 5"), toy.filter("year = 2002")
    _, (filled,) = M.impute_from_train(train, [test], ["b"])
    median = train.filter(~F.isnan("b")).agg(F.percentile("b", F.lit(0.5))).first()[0]
    got = {r["b"] for r in filled.filter("cell % 7 = 0").collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(median, abs=0.2)
    whole = M.impute_all(toy.withColumn("none", F.lit(None).cast("double")), ["b", "none"])
    assert whole.filter("none <> 0 OR isnan(b)").isEmpty()


def test_boosted_trees_rank_the_target(toy):
    s = M.TreeSettings(rounds=5, depth=3)
    out = M.fit_categories(toy.filter("year < 2002"), toy.filter("year = 2002"), ["k"], ["a", "b"], s)
    assert out.count() == 200 and out.filter("pred < 0").isEmpty()
    assert out.agg(F.corr("pred", "target")).first()[0] > 0.7


def greedy(x, y, rounds, leaves, step, least):
    """Boosting by exhaustive search over all cuts, leaf by leaf."""
    f = np.full(len(y), y.mean())
    for _ in range(rounds):
        groups = [np.arange(len(y))]
        while len(groups) < leaves:
            options = []
            for g, rows in enumerate(groups):
                r = y[rows] - f[rows]
                for j in range(x.shape[1]):
                    for v in np.unique(x[rows, j])[:-1]:
                        low = x[rows, j] <= v
                        if min(low.sum(), (~low).sum()) >= least:
                            gain = sum(p.sum() ** 2 / len(p) for p in (r[low], r[~low])) - r.sum() ** 2 / len(r)
                            options.append((round(gain, 9), -g, rows[low], rows[~low], g))
            options = [o for o in options if o[0] > 1e-9]
            if not options:
                break
            _, _, a, b, g = max(options, key=lambda o: (o[0], o[1]))
            groups[g : g + 1] = [a]
            groups.append(b)
        change = np.zeros(len(y))
        for rows in groups:
            change[rows] = step * (y[rows] - f[rows]).mean()
        f += change
    return f


def test_histogram_trees_match_exhaustive_search():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = np.sin(x[:, 0]) * 3 + x[:, 1] * 0.3 + rng.normal(size=150)
    settings = B.TreeSettings(rounds=8, leaves=5, step=0.3, min_leaf=9)
    model = B.fit(x, y.copy(), settings)
    assert np.allclose(B.predict(model, x), greedy(x, y, 8, 5, 0.3, 9))
    assert np.isclose(B.predict(B.fit(x[:5], y[:5].copy(), settings), x).std(), 0)
    gaps = np.where(rng.random(x.shape) < 0.2, np.nan, x)
    gaps[:, 2] = np.nan
    again = B.fit(gaps, y.copy(), settings)
    filled = np.where(np.isnan(gaps), np.append(np.nanmedian(gaps[:, :2], axis=0), 0.0), gaps)
    assert np.allclose(B.predict(again, gaps), B.predict(B.fit(filled, y.copy(), settings), filled))


@pytest.mark.parametrize("leaves", [2, 16, 40, 90])
def test_leaves_by_bits_are_those_of_the_walk(leaves):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((3000, 3)) < 0.1, np.nan, np.round(rng.normal(size=(3000, 3)), 2))
    model = B.fit(x, rng.normal(size=3000) + np.nan_to_num(x[:, 0]), B.TreeSettings(rounds=6, leaves=leaves))
    filled = np.where(np.isnan(x), model["medians"], x)
    want = np.full(len(x), model["base"][0])
    for root in model["roots"]:
        want += B._walk(model, root, filled)
    assert (B.predict(model, x) == want).all()


def test_trees_grow_on_sums_of_equal_rows():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 4, (5000, 3))
    y = rng.normal(size=5000)
    cells, number, total = B._cells(codes, y)
    assert len(cells) == 64 and number.sum() == 5000
    for c, n, t in zip(cells, number, total):
        same = (codes == c).all(axis=1)
        assert same.sum() == n and np.isclose(y[same].sum(), t)


def test_many_models_are_ranked_without_a_row_per_prediction(spark, toy, monkeypatch):
    rows = toy.filter("NOT isnan(target)").withColumns({"x": F.array("a", "b"), "district": F.concat(F.lit("d"), (F.col("cell") % 7).cast("string"))})
    rows = rows.withColumn("other", F.array(F.col("target") % 3, F.col("target") % 5)).select("category", "district", "cell", "x", "target", "other")
    each = rows.withColumn("slot", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))).withColumn("y", F.log1p(F.abs(F.col("target"))) * (F.col("slot") + 1))
    models = B.fit_models(each.select("category", "slot", "x", "y"), ["category", "slot"], [B.TreeSettings(rounds=5, leaves=4)] )
    models = models.localCheckpoint()
    scored = B.predict_models(models, each.withColumn("other", F.element_at("other", (F.col("slot") + 1).cast("int"))), ["category", "slot"], "x", "_p").withColumn("pred", F.expm1(F.greatest("_p", F.lit(0.0))))
    want = {}
    for name, pair in (("a", ("pred", "target")), ("b", ("other", "pred"))):
        for r in M.within_district(scored, *pair, ("category", "slot", "district")).collect():
            want[r["category"], r["slot"], r["district"], name] = (pytest.approx(r["rho"], abs=1e-12), r["n"])
    for large in (250_000, 10):
        got = M.model_rho(models, rows, ["category"], {"a": ("pred", "target"), "b": ("other", "pred")}, part_rows=40, large_rows=large).collect()
        assert {(r["category"], r["slot"], r["district"], r["score"]): (r["rho"], r["n"]) for r in got} == want and want
        assert len(got) == len(want)


def test_degradation_agrees_with_separate_fits(toy):
    panel = toy.filter("NOT isnan(target)").withColumns({"district": F.concat(F.lit("d"), (F.col("cell") % 6).cast("string")), "persist": F.floor(F.abs(F.col("a")) * 5), "target": F.floor(F.abs(F.col("target")) * 3).cast("double"), "category": F.lit("k")})
    panel = panel.withColumn("persist", F.col("persist").cast("double"))
    years = [r[0] for r in panel.select("year").distinct().orderBy("year").collect()]
    key, settings = (lambda d: F.concat_ws(":", "cell", "year")), B.TreeSettings(rounds=6, leaves=4)
    out = {(r["rate"], r["seed"]): r for r in M.degradation(panel, [0.8, 0.3], 0.8, [0, 3], years[:-1], years[-1], ["k"], ["a", "b"], key, settings).collect()}
    assert len(out) == 4
    for (rate, seed), r in out.items():
        d = P.thin_counts(P.thin_counts(panel, key(panel), "target", "thin", rate, 0.8, seed), key(panel), "persist", "thin_p", rate, 0.8, seed + 7)
        scored = M.fit_categories(d.filter(F.col("year").isin(years[:-1])), d.filter(F.col("year") == years[-1]), ["k"], ["a", "b"], settings, "thin").localCheckpoint()
        for name, pair in (("measurable", ("pred", "thin")), ("actual", ("pred", "target")), ("persist", ("thin_p", "thin"))):
            want = M.macro(M.within_district(scored, *pair), "rho").first()["macro_rho"]
            assert r[name] == pytest.approx(want, abs=1e-9)


def test_models_of_all_keys_are_fitted_alike(toy):
    rows = toy.filter("NOT isnan(target)").withColumn("setting", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.array("a", "b"))
    grid = [B.TreeSettings(rounds=4), B.TreeSettings(rounds=7, leaves=4)]
    models = B.fit_models(rows.select("category", "setting", "x", F.col("target").alias("y")), ["category", "setting"], grid)
    got = {(r["setting"], r["cell"]): r["p"] for r in B.predict_models(models, rows, ["category", "setting"], "x", "p").collect()}
    local = rows.filter("setting = 0").toPandas()
    x, y = np.stack(local["x"].to_numpy()).astype(float), local["target"].to_numpy()
    for i, s in enumerate(grid):
        want = B.predict(B.fit(x, y.copy(), s), x)
        assert np.allclose([got[i, c] for c in local["cell"]], want)
    # Rows beyond the bound leave the fit, never the prediction.
    few = B.fit_models(rows.filter("setting = 0").select("category", "x", "cell", F.col("target").alias("y")), ["category"], fit_rows=100)
    assert B.predict_models(few, rows.filter("setting = 0"), ["category"], "x", "p").count() == 600


def test_every_row_is_fitted_whatever_the_bound(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = np.stack([rng.poisson(2.0, n), np.round(rng.normal(size=n), 3), rng.integers(0, 40, n), np.full(n, np.nan)], axis=1).astype(float)
    x[:, :2][rng.random((n, 2)) < 0.05] = np.nan
    y = np.stack([np.nan_to_num(x[:, 0]) + rng.normal(size=n), x[:, 2] * np.nan_to_num(x[:, 1])], axis=1)
    key = rng.integers(0, 2, n)
    data = [(int(k), [float(v) for v in r], float(a), float(b)) for k, r, (a, b) in zip(key, x, y)]
    rows = spark.createDataFrame(data, "k int, x array<double>, a double, b double").repartition(3)
    grid = [B.TreeSettings(rounds=5), B.TreeSettings(rounds=4, leaves=6, step=0.3, bins=20)]
    models = B.fit_models(rows, ["k"], grid, y=["a", "b"], fit_rows=50, width=4)
    assert set(models.columns) == {"k", "slot", "setting", *B.MODEL_PARTS}
    got = {(r["k"], r["slot"], r["setting"]): {m: np.array(r[m]) for m in B.MODEL_PARTS} for r in models.collect()}
    assert len(got) == 8
    for (k, slot, setting), model in got.items():
        own = key == k
        want = B.fit(x[own], y[own, slot].copy(), grid[setting])
        assert (model["medians"] == want["medians"]).all()
        assert np.allclose(B.predict(model, x), B.predict(want, x))


@pytest.mark.parametrize("n", [30, 256, 4001])
def test_edges_come_from_counted_values(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random((n, 2)) < [0.0, 0.3], np.nan, np.round(rng.normal(size=(n, 2)), 3))
    distinct = spark.createDataFrame([(1, *(None if np.isnan(v) else float(v) for v in r)) for r in x], "k int, _x0 double, _x1 double").groupBy("k", "_x0", "_x1").agg(F.count("*").alias("_rows"))
    for bins in (255, 7):
        row = B._bounds(distinct, ["k"], ["_x0", "_x1"], bins).first()
        medians = np.nanmedian(x, axis=0)
        assert row["medians"] == list(medians)
        for own, want in zip(row["edges"], B._binned(np.where(np.isnan(x), medians, x), bins)[1]):
            assert own == want.tolist()


def test_degradation_does_not_depend_on_the_bound(toy, monkeypatch):
    panel = toy.filter("NOT isnan(target)").withColumns({"district": F.concat(F.lit("d"), (F.col("cell") % 6).cast("string")), "persist": F.floor(F.abs(F.col("a")) * 5).cast("double"), "target": F.floor(F.abs(F.col("target")) * 3).cast("double")})
    given, found, whole = (lambda d: F.concat_ws(":", "cell", "year")), [], M.fit_models
    for bound in (500_000, 40):
        monkeypatch.setattr(M, "fit_models", lambda *a, **k: whole(*a, **k, fit_rows=bound))
        rows = M.degradation(panel, [0.4], 0.8, [1], [2000, 2001], 2002, ["k"], ["a", "b"], given, B.TreeSettings(rounds=4, leaves=6)).collect()
        found.append([pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in rows[0]])
    assert len(rows) == 1 and list(rows[0]) == found[0]


def test_draws_by_arrays_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(P, "DRAWN", 37)
    names = ["a", "é:1", None, "", "x" * 60, *(f"{i}:1999:A" for i in range(95))]
    counts = [3.0, 12.0, 2.0, None, 4.0, *(float(i % 5) for i in range(95))]
    draws = [(0.5, 0.83, 3), (0.05, 0.83, 0), (0.83, 0.83, 1), (0.9, 1.0, 12)]
    d = spark.createDataFrame(list(zip(range(100), names, counts)), "i int, name string, n double").repartition(3)
    want = d.select("i", F.array(*[P.thinned_count(F.col("name"), "n", *w) for w in draws]).alias("w")).collect()
    got = {r["i"]: r["w"] for r in P.thinned_counts(d, F.col("name"), "n", "w", draws).collect()}
    assert {r["i"]: r["w"] for r in want} == got
    assert P.thinned_counts(d.limit(0), F.col("name"), "n", "w", draws).count() == 0


def test_split_members(spark):
    panel = spark.range(40).select(F.col("id").alias("cell"), F.concat(F.lit("d"), (F.col("id") % 8).cast("string")).alias("district"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("year"))
    near = spark.createDataFrame([(f"d{i}", f"d{j}") for i in range(8) for j in (i - 1, i + 1) if 0 <= j < 8], "a string, b string")
    rows = M.split_members(panel, near, [1, 2], 3, 4).collect()
    for split in M.SPLITS:
        own = [r for r in rows if r["split"] == split]
        assert sorted(r["cell"] for r in own if r["part"] == "test") == list(range(40))
        for fold in {r["fold"] for r in own}:
            parts = {p: [r for r in own if r["fold"] == fold and r["part"] == p] for p in ("train", "test")}
            assert all(r["year"] == 3 for r in parts["test"]) and all(r["year"] < 3 for r in parts["train"])
            key = {M.SPLITS[0]: "year", M.SPLITS[1]: "cell"}.get(split, "district")
            assert not {r[key] for r in parts["train"]} & {r[key] for r in parts["test"]}
            if split == M.SPLITS[3]:
                tested, trained = ({int(r["district"][1]) for r in parts[p]} for p in ("test", "train"))
                assert not any(abs(a - b) == 1 for a in tested for b in trained)


def test_clusters_and_plane(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:3]
    rows = [(i, [float(v) for v in centres[i % 3] + 0.05 * rng.normal(size=6)]) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    groups = M.cluster_vectors(d, 3).groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct("cluster").alias("n")).collect()
    assert all(r["n"] == 1 for r in groups)
    top = M.plane_coordinates(d).agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    assert tuple(top) == (1.0, 1.0)
