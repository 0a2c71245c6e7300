"""Per-category models and the experiments built on them; all models of an experiment are fitted together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyveil.functions.codes import back_transform, log_target
from tallyveil.functions.vectors import l2_normalise
from tallyveil.operators.boosting import MODEL_PARTS, PART_ROWS, TreeSettings, alike_rows, feature_matrix, fit_models, predict, predict_models
from tallyveil.operators.panel import seeded_folds, thin_draws, thinned_counts
from tallyveil.operators.ranking import MIN_CELLS, grouped_rho, macro, metric_pack, top_share, within_district
from tallyveil.operators.resample import bootstrap_by_category, bootstrap_delta, pair_models, replication, significance
from tallyveil.session import cut_lineage, literal_rows

#: Districts of up to so many rows are ranked for all models in one task.
LARGE_DISTRICT = 250_000


def impute_from_train(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """ML-01: medians of the train rows fill every part."""
    model = Imputer(strategy="median", relativeError=1e-4, inputCols=list(columns), outputCols=list(columns)).fit(train)
    return model.transform(train), [model.transform(o) for o in others]


def impute_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ML-02: column medians; a column without any value becomes zero."""
    row = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    filled = [c for c in columns if row[c] > 0]
    out = df.fillna(0.0, [c for c in columns if row[c] == 0])
    if not filled:
        return out
    return Imputer(strategy="median", relativeError=1e-4, inputCols=filled, outputCols=filled).fit(out).transform(out)


def fit_keyed(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str | Column], settings: Sequence[TreeSettings] = (TreeSettings(),),
              target: str = "target", name: str = "pred") -> DataFrame:
    """ML-03: boosted trees on log1p of the target, one model per key; predictions back on the count scale.

    Missing features take the medians of the model's own train rows. Test rows of keys without train rows are left out.
    ``features`` may be columns; a feature that a key's model must not see is null there.
    """
    x = _features(features)
    models = cut_lineage(fit_models(train.select(*keys, x.alias("x"), log_target(target).alias("y")), keys, settings, width=len(features)))
    scored = predict_models(models, test.withColumn("_x", x), keys, "_x", "_p")
    return scored.withColumn(name, back_transform("_p")).drop("_p")


def fit_categories(train: DataFrame, test: DataFrame, categories: Sequence[str], features: Sequence[str],
                   settings: TreeSettings = TreeSettings(), target: str = "target", name: str = "pred") -> DataFrame:
    """One model per category; predictions of all categories as one table."""
    here = F.col("category").isin(list(categories))
    return fit_keyed(train.filter(here), test.filter(here), ["category"], features, [settings], target, name)


def model_rho(models: DataFrame, rows: DataFrame, shared: Sequence[str], scores: Mapping[str, tuple[str, str]], district: str = "district",
              part_rows: int = PART_ROWS, large_rows: int = LARGE_DISTRICT, min_rows: int = MIN_CELLS,
              thinned: Mapping[str, tuple[str, str, Sequence[tuple[float, float, int]]]] | None = None) -> DataFrame:
    """M-04 for several models on the same rows: (shared, slot, district, score, rho, n), without a row per model and prediction.

    ``models``: shared keys, ``slot`` (bigint, the model's own number) and the model; ``rows``: shared keys, district, ``x`` and columns
    that ``scores`` names as pairs (prediction, target), where ``pred`` is the model's prediction; an array column holds a value per slot.
    ``thinned`` names columns of counts thinned for each slot (key column, value column, rate, base and seed per slot), drawn where they are used.
    Whole districts are dealt out in parts of about ``part_rows`` rows, each part meets its models once. Districts of more than
    ``large_rows`` rows are spelled out per model and ranked over slices.
    """
    shared, thinned = list(shared), dict(thinned or {})
    for k in [*shared, district]:
        rows = rows.filter(F.col(k).isNotNull())
    rows = cut_lineage(rows)
    sizes = cut_lineage(rows.groupBy(*shared, district).agg(F.count("*").alias("_n")))
    large = cut_lineage(sizes.filter(F.col("_n") > large_rows).select(*shared, district))
    many = not large.isEmpty()
    usual = rows.join(large, [*shared, district], "left_anti") if many else rows
    # One row per list of models.
    parts = sizes.filter(F.col("_n") <= large_rows).groupBy(*shared).agg(F.ceil(F.sum("_n") / part_rows).cast("int").alias("_parts"))
    dealt = usual.join(F.broadcast(parts), shared).withColumn("_part", F.pmod(F.xxhash64(district), F.col("_parts")).cast("int")).drop("_parts")
    copies = models.join(F.broadcast(parts), shared).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copies = copies.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(shared)], "_copy", "slot", *MODEL_PARTS)
    kinds = [rows.schema[k] for k in [*shared, district]]
    schema = T.StructType([*kinds[:-1], T.StructField("slot", T.LongType()), kinds[-1], T.StructField("score", T.StringType()), T.StructField("rho", T.DoubleType()), T.StructField("n", T.LongType())])

    def values(column: pa.ChunkedArray, slot: int = 0) -> np.ndarray:
        if pa.types.is_list(column.type):
            column = pc.list_element(column, slot)
        return column.combine_chunks().to_numpy(zero_copy_only=False).astype(float)

    named = {c for pair in scores.values() for c in pair} - {"pred"} - set(thinned)

    def rate(key, group, given):
        found: list[list] = []
        if group.num_rows and given.num_rows:
            x, names = feature_matrix(group["x"]), pc.dictionary_encode(group[district].combine_chunks())
            place = names.indices.to_numpy(zero_copy_only=False)
            plain = {c: values(group[c]) for c in named if not pa.types.is_list(group[c].type)}
            drawn = {c: thin_draws(group[k].combine_chunks(), values(group[v]), draws) for c, (k, v, draws) in thinned.items()}
            first, which = alike_rows(x)
            for m in range(given.num_rows):
                slot = given["slot"][m].as_py()
                pred = np.expm1(np.maximum(predict({n: given[n][m].values.to_numpy(zero_copy_only=False) for n in MODEL_PARTS}, x[first]), 0.0))
                # Only the order of predictions matters: numbers of their values stand for them.
                pred = np.where(np.isfinite(pred), np.unique(pred, return_inverse=True)[1], np.nan)[which]
                for score, pair in scores.items():
                    a, b = (pred if c == "pred" else drawn[c][slot] if c in drawn else plain[c] if c in plain else values(group[c], slot) for c in pair)
                    for d, rho, n in grouped_rho(place, a, b, min_rows):
                        found.append([*[k.as_py() for k in key[:-1]], slot, names.dictionary[d].as_py(), score, rho, n])
        return pa.Table.from_pylist([dict(zip(schema.names, f)) for f in found], to_arrow_schema(schema))

    by = [f"_m{i}" for i in range(len(shared))]
    out = dealt.groupBy(*shared, "_part").cogroup(copies.groupBy(*by, "_copy")).applyInArrow(rate, schema)
    if not many:
        return out
    spelled = rows.join(large, [*shared, district], "left_semi")
    for c, (k, v, draws) in thinned.items():
        spelled = thinned_counts(spelled, F.col(k), v, c, draws)
    lists = {f.name for f in spelled.schema if isinstance(f.dataType, T.ArrayType) and f.name != "x"}
    spelled = spelled.join(F.broadcast(models.select(*shared, "slot")), shared)
    spelled = spelled.withColumns({c: F.element_at(c, (F.col("slot") + 1).cast("int")) for c in lists}) if lists else spelled
    scored = cut_lineage(predict_models(models, spelled, [*shared, "slot"], "x", "_p").withColumn("pred", back_transform("_p")))
    for score, pair in scores.items():
        rho = within_district(scored, *pair, (*shared, "slot", district), min_rows)
        out = out.unionByName(rho.select(*shared, "slot", district, F.lit(score).alias("score"), "rho", "n"))
    return out


def _features(features: Sequence[str | Column]) -> Column:
    return F.array(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])


def _scored_columns(features: Sequence[str]) -> list[str]:
    """What a fit and ``metric_pack`` need of the panel; nothing else is moved."""
    return list(dict.fromkeys(["category", "district", "cell", "target", *features]))


def _tested(rows: DataFrame, categories: Sequence[str], features: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """What ``model_rho`` needs of test rows."""
    here = rows.filter(F.col("category").isin(list(categories)))
    return here.select("category", "district", _features(features).alias("x"), F.col("target").cast("double").alias("target"), *columns)


def _slots(models: DataFrame, own: str) -> DataFrame:
    """Fitted models, written once, with their own key as ``slot``."""
    return cut_lineage(models.withColumn("slot", F.col(own).cast("bigint")).drop(own))


def _for_each(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once for each value of a short list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def ladder(train: DataFrame, test: DataFrame, categories: Sequence[str], steps: Mapping[str, Sequence[str]],
           settings: TreeSettings = TreeSettings()) -> DataFrame:
    """ML-04: nested feature sets, metric pack per step and category."""
    every = list(dict.fromkeys(f for features in steps.values() for f in features))
    x = [F.when(F.col("model").isin([m for m, own in steps.items() if f in own]), F.col(f)) for f in every]
    train, test = (_for_each(d.filter(F.col("category").isin(list(categories))).select(*_scored_columns(every)), "model", list(steps)) for d in (train, test))
    return metric_pack(cut_lineage(fit_keyed(train, test, ["model", "category"], x, [settings])), "pred", by=["model"])


def baselines(test: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """ML-05: existing columns scored as if they were predictions.

    The rows are read once for all columns, and ranked together.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("_pred")) for name, c in columns.items()])).alias("_m")
    rows = test.select("category", "district", "cell", "target", each).select("*", "_m.model", "_m._pred").drop("_m")
    pack = metric_pack(rows, "_pred", by=["model"])
    return pack.select(*[c for c in pack.columns if c != "model"], "model")


SPLITS = ("temporal_holdout", "random_cell_cv", "spatial_grouped_cv", "buffered_spatial_cv")
MACRO = "__macro__"


def split_members(panel: DataFrame, adjacency: DataFrame, train_years: Sequence[int], test_year: int, folds: int, seed: int = 42) -> DataFrame:
    """ML-11: rows of the panel with split, fold and part for all four kinds of splits; folds count from 1, the temporal one is 0.

    Test rows are those of the test year in a fold's own cells or districts, train rows those of the train years in the others; the
    buffered kind also takes districts next to a test district (``adjacency``: a, b) out of the train rows.
    """
    part = F.when(F.col("year").isin(list(train_years)), "train").when(F.col("year") == test_year, "test")
    rows = panel.withColumn("part", part).filter("part IS NOT NULL")
    temporal = rows.withColumns({"split": F.lit(SPLITS[0]), "fold": F.lit(0).cast("bigint")})
    out = [temporal]

    def spread(d: DataFrame, own: DataFrame, key: str) -> DataFrame:
        other = F.sequence(F.lit(1).cast("bigint"), F.lit(folds).cast("bigint"))
        each = d.join(own.withColumn("_own", F.col("fold") + 1).drop("fold"), key)
        trained = F.filter(other, lambda f: f != F.col("_own"))
        return each.withColumn("fold", F.explode(F.when(F.col("part") == "test", F.array("_own")).otherwise(trained))).drop("_own")

    for name, key in ((SPLITS[1], "cell"), (SPLITS[2], "district")):
        own = cut_lineage(seeded_folds(panel, key, folds, seed))
        out.append(spread(rows, own, key).withColumn("split", F.lit(name)))
    grouped = out[-1]
    tested = own.select((F.col("fold") + 1).alias("fold"), F.col("district").alias("b"))
    near = adjacency.join(tested, "b").select(F.col("a").alias("district"), "fold", F.lit("train").alias("part")).distinct()
    out.append(grouped.join(near, ["district", "fold", "part"], "left_anti").withColumn("split", F.lit(SPLITS[3])))
    return reduce(DataFrame.unionByName, out)


def evaluate_folds(members: DataFrame, categories: Sequence[str], features: Sequence[str], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """ML-11: metric pack per (split, fold, category), and the mean over categories as category ``__macro__``.

    All models of all splits and folds are fitted together. ``members``: panel rows with split, fold and part.
    """
    keys = ["split", "fold", "category"]
    members = members.filter(F.col("category").isin(list(categories))).select(*dict.fromkeys([*keys, "part", *_scored_columns(features)]))
    scored = cut_lineage(fit_keyed(members.filter("part = 'train'"), members.filter("part = 'test'"), keys, features, [settings]))
    pack = cut_lineage(metric_pack(scored, "pred", by=["split", "fold"]))
    values = [c for c in pack.columns if c not in keys]
    mean = pack.groupBy("split", "fold").agg(*[F.avg(v).alias(v) for v in values]).withColumn("category", F.lit(MACRO))
    sizes = members.groupBy("split", "fold").agg(*[F.count_distinct(F.when(F.col("part") == p, F.col("district"))).alias(f"{p}_districts") for p in ("train", "test")])
    both = pack.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unionByName(mean.select(*keys, *values))
    return both.join(sizes, ["split", "fold"])


def transfer(source: DataFrame, local_train: DataFrame, test: DataFrame, categories: Sequence[str], features: Sequence[str],
             settings: TreeSettings = TreeSettings()) -> DataFrame:
    """ML-13: model of another region and of the own region, persistence and population on one test set."""
    test = test.select(*dict.fromkeys([*_scored_columns(features), "persist", "population"]))
    a = fit_categories(source, test, categories, features, settings, name="transfer")
    b = fit_categories(local_train, a, categories, features, settings, name="local")
    return cut_lineage(b)


def transfer_scores(scored: DataFrame, models: Sequence[str] = ("transfer", "local", "persist", "population"), replicates: int = 2000) -> DataFrame:
    """ML-13: macro rho per model, with the paired interval of the first model's difference to it (null for itself)."""
    stats = {m: cut_lineage(within_district(scored, m)) for m in models}
    rows = []
    for m in models:
        row = macro(stats[m], "rho").withColumn("model", F.lit(m))
        delta = significance(bootstrap_delta(pair_models(stats[m], stats[models[0]], "rho"), "rho", replicates=replicates))
        delta = delta.select(*[F.when(F.lit(m != models[0]), F.col(c)).alias(n) for c, n in (("point", "lead"), ("ci_low", "lead_low"), ("ci_high", "lead_high"), ("significant", "significant"))])
        rows.append(row.crossJoin(delta))  # single rows
    return reduce(DataFrame.unionByName, rows)


def rare_capture(scored: DataFrame, category: str, models: Sequence[str] = ("transfer", "local", "persist", "population"), replicates: int = 2000) -> DataFrame:
    """ML-13: a rare category's events in each model's top tenth, and the paired interval of the first model against the second."""
    rare = cut_lineage(scored.filter(F.col("category") == category))
    paired = pair_models(within_district(rare, models[1]), within_district(rare, models[0]), "rho")
    delta = significance(bootstrap_by_category(paired, "rho", replicates=replicates)).withColumnsRenamed({"point": "lead", "ci_low": "lead_low", "ci_high": "lead_high"})
    rows = [top_share(rare, ["category"], m, "target", "cell", "ceil").withColumn("model", F.lit(m)) for m in models]
    shares = reduce(DataFrame.unionByName, rows).join(rare.groupBy("category").agg(F.sum("target").alias("events")), "category")
    return shares.join(delta, "category", "left")


def learning_curve(source: DataFrame, local: DataFrame, test: DataFrame, years: Sequence[int], categories: Sequence[str],
                   features: Sequence[str], settings: TreeSettings = TreeSettings(), replicates: int = 2000) -> DataFrame:
    """ML-14: local models on growing windows against the fixed transfer model."""
    moved = cut_lineage(within_district(fit_categories(source, test, categories, features, settings, name="transfer"), "transfer"))
    sizes = list(range(1, len(years) + 1))
    own = _for_each(local.filter(F.col("category").isin(list(categories))), "years", sizes)
    window = reduce(lambda a, n: a | ((F.col("years") == n) & F.col("year").isin(list(years)[-n:])), sizes, F.lit(False))
    models = fit_models(own.filter(window).select("years", "category", _features(features).alias("x"), log_target("target").alias("y")), ["years", "category"], [settings], width=len(features))
    stats = cut_lineage(model_rho(_slots(models, "years"), _tested(test, categories, features), ["category"], {"rho": ("pred", "target")}).withColumnRenamed("slot", "years"))
    rows = []
    for n in sizes:
        delta = bootstrap_delta(pair_models(moved, stats.filter(F.col("years") == n), "rho"), "rho", replicates=replicates)
        rows.append(significance(delta).withColumn("years", F.lit(n)))
    return reduce(DataFrame.unionByName, rows)


def year_replication(panel: DataFrame, test_years: Sequence[int], first_year: int, categories: Sequence[str],
                     small: Sequence[str], large: Sequence[str], expected: str = "positive",
                     settings: TreeSettings = TreeSettings(), replicates: int = 2000) -> DataFrame:
    """ML-15: the same model comparison repeated for several test years."""
    each = _for_each(_for_each(panel.filter(F.col("category").isin(list(categories))), "test_year", list(test_years)), "size", [0, 1])
    every = list(dict.fromkeys([*small, *large]))
    x = F.array(*[F.when(F.col("size").isin([i for i, own in enumerate((small, large)) if f in own]), F.col(f).cast("double")) for f in every])
    train = each.filter((F.col("year") >= first_year) & (F.col("year") < F.col("test_year")))
    models = fit_models(train.select("test_year", "size", "category", x.alias("x"), log_target("target").alias("y")), ["test_year", "size", "category"], [settings], width=len(every))
    # A model never cuts by a feature that it has not seen, so both sizes predict from the same rows.
    tested = each.filter("year = test_year AND size = 0").select("test_year", "category", "district", _features(every).alias("x"), F.col("target").cast("double").alias("target"))
    stats = cut_lineage(model_rho(_slots(models, "size"), tested, ["test_year", "category"], {"rho": ("pred", "target")}).withColumnRenamed("slot", "size"))
    rows = []
    for year in test_years:
        pair = [stats.filter((F.col("test_year") == year) & (F.col("size") == i)) for i in (0, 1)]
        delta = bootstrap_delta(pair_models(*pair, "rho"), "rho", replicates=replicates)
        rows.append(replication(significance(delta), F.lit(expected)).withColumn("test_year", F.lit(year)))
    return reduce(DataFrame.unionByName, rows)


#: 18 settings around the defaults: rounds, leaves, step sizes.
GRID = tuple(TreeSettings(rounds=r, leaves=n, step=s) for r in (140, 300) for n in (15, 31, 63) for s in (0.03, 0.06, 0.1))


def tune(panel: DataFrame, train_years: Sequence[int], validation_year: int, test_year: int, categories: Sequence[str],
         features: Sequence[str], grid: Sequence[TreeSettings] = GRID) -> DataFrame:
    """ML-16: settings chosen per category on a later year, then one final test: (category, rho, setting).

    Ties go to the setting named first. All settings are fitted together.
    """
    panel = panel.filter(F.col("category").isin(list(categories)))
    keys = ["setting", "category"]
    train = panel.filter(F.col("year").isin(list(train_years))).select("category", _features(features).alias("x"), log_target("target").alias("y"))
    tested = _tested(panel.filter(F.col("year") == validation_year), categories, features)
    models = fit_models(train, ["category"], dict(enumerate(grid)), width=len(features))
    stats = model_rho(_slots(models, "setting"), tested, ["category"], {"rho": ("pred", "target")})
    rho = stats.groupBy(F.col("slot").cast("int").alias("setting"), "category").agg(F.avg("rho").alias("rho"))
    chosen = cut_lineage(rho.groupBy("category").agg(F.max_by("setting", F.struct("rho", -F.col("setting"))).alias("setting")))
    # A category without a score keeps the first setting; one row per category.
    final = panel.join(F.broadcast(chosen), "category", "left").fillna({"setting": 0})
    scored = fit_keyed(final.filter(F.col("year").isin([*train_years, validation_year])), final.filter(F.col("year") == test_year), keys, features, grid)
    return within_district(scored, "pred", keys=(*keys, "district")).groupBy("category", "setting").agg(F.avg("rho").alias("rho"))


def degradation(panel: DataFrame, rates: Sequence[float], base: float, seeds: Sequence[int], train_years: Sequence[int],
                test_year: int, categories: Sequence[str], features: Sequence[str], key: Callable,
                settings: TreeSettings = TreeSettings()) -> DataFrame:
    """ML-18: refit on thinned counts; skill against thinned and full targets, and persistence: one row per rate and seed."""
    panel = cut_lineage(panel.filter(F.col("category").isin(list(categories)) & F.col("year").isin([*train_years, test_year])))
    drawn = [(float(rate), seed) for rate in rates for seed in seeds]

    def draws(shift: int) -> list[tuple[float, float, int]]:
        return [(rate, base, seed + shift) for rate, seed in drawn]

    # A row's thinned counts are drawn where they are used: a train row is summed with equal ones for all rates and seeds at once,
    # a test row travels as it is.
    own = panel.withColumn("_name", key(panel))
    train = own.filter(F.col("year").isin(list(train_years))).select("category", _features(features).alias("x"), F.col("target").cast("double").alias("target"), "_name")
    train = thinned_counts(train, F.col("_name"), "target", "_thin", draws(0))
    targets = [f"_t{i}" for i in range(len(drawn))]
    train = train.select("category", "x", *[log_target(F.col("_thin")[i]).alias(t) for i, t in enumerate(targets)])
    models = cut_lineage(fit_models(train, ["category"], [settings], y=targets, width=len(features)))
    tested = _tested(own.filter(F.col("year") == test_year), categories, features, ["_name", F.col("persist").cast("double").alias("persist")])
    scores = {"measurable": ("pred", "thin_target"), "actual": ("pred", "target"), "persist": ("thin_persist", "thin_target")}
    thinned = {"thin_target": ("_name", "target", draws(0)), "thin_persist": ("_name", "persist", draws(7))}
    stats = cut_lineage(model_rho(models, tested, ["category"], scores, thinned=thinned))
    listed = F.array(*[F.struct(F.lit(rate).alias("rate"), F.lit(seed).alias("seed")) for rate, seed in drawn])
    out = panel.limit(1).select(F.posexplode(listed).alias("slot", "_own")).select("slot", "_own.rate", "_own.seed")
    for name in scores:
        out = out.join(macro(stats.filter(F.col("score") == name), "rho", by=["slot"]).select("slot", F.col("macro_rho").alias(name)), "slot", "left")
    return out.drop("slot").withColumn("features_win", F.col("measurable") > F.col("persist"))


def cluster_vectors(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """ML-22: k-means on unit vectors (squared distance on the sphere orders like cosine)."""
    data = vectors.select("id", array_to_vector(l2_normalise(F.col("vec"))).alias("features"))
    model = KMeans(k=k, seed=seed, initMode="k-means||", maxIter=20).fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("cluster"))


def sweep_clusters(vectors: DataFrame, ks: Sequence[int], describe: Callable[[DataFrame], DataFrame], marked: DataFrame,
                   seed: int = 42) -> DataFrame:
    """ML-23: per k, flagged clusters and the share of marked members inside them.

    ``describe`` maps (id, k, cluster) of all k to (k, cluster, flagged).
    """
    members = cut_lineage(reduce(DataFrame.unionByName, [cluster_vectors(vectors, k, seed).withColumn("k", F.lit(k)) for k in ks]))
    inside = members.join(describe(members), ["k", "cluster"]).join(marked.select("id", F.lit(True).alias("_m")), "id", "left")
    m = F.coalesce("_m", F.lit(False))
    found = inside.groupBy("k").agg(
        F.count_distinct(F.when(F.col("flagged"), F.col("cluster"))).alias("flagged_clusters"),
        F.count_if(m & F.col("flagged")).alias("marked_inside"), F.count_if(m).alias("marked"),
        (F.count_if(F.col("flagged")) / F.count("*")).alias("share_inside"),
    )
    listed = literal_rows(vectors.sparkSession, [(k,) for k in ks], "k int")
    counts = ["flagged_clusters", "marked_inside", "marked"]
    return listed.join(found, "k", "left").fillna(0, counts).select(*counts, "share_inside", "k")


def plane_coordinates(vectors: DataFrame) -> DataFrame:
    """ML-24 / F-24: two principal components of centred unit vectors, scaled by the largest value."""
    data = vectors.select("id", array_to_vector(l2_normalise(F.col("vec"))).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    plane = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return scale_plane(plane.select("id", vector_to_array("_p")[0].alias("x"), vector_to_array("_p")[1].alias("y")))


def scale_plane(points: DataFrame) -> DataFrame:
    """F-24: coordinates over the largest absolute value per axis, four decimals."""
    top = points.agg(F.max(F.abs("x")).alias("_mx"), F.max(F.abs("y")).alias("_my"))
    return points.crossJoin(top).select(
        *[c for c in points.columns if c not in ("x", "y")],
        F.round(F.col("x") / (F.col("_mx") + F.lit(1e-9)), 4).alias("x"), F.round(F.col("y") / (F.col("_my") + F.lit(1e-9)), 4).alias("y"),
    )
