"""Models and the experiments built on them over the shared tables.

The registered runs have the published sizes: 140 rounds of 15 leaves, 18 settings, ten seeds, four kinds of splits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.operators import corpus as C
from tallyveil.operators import models as M
from tallyveil.operators import panel as P
from tallyveil.plans.catalog import CATEGORIES, TEST_YEAR, YEARS, Tables, query
from tallyveil.session import cut_lineage

FEATURES = ["persist", "lag2", "population", "price"]


def _panel(t: Tables):
    return cut_lineage(t.panel())


def _split(d, test_year: int = TEST_YEAR):
    return d.filter(F.col("year") < test_year), d.filter(F.col("year") == test_year)


@query("ml01_train_medians")
def _(t):
    d = t.panel().withColumn("population", F.when(F.col("population") > 0, F.col("population")))
    train, test = _split(d)
    _, (filled,) = M.impute_from_train(train, [test], ["population", "lag2"])
    return filled.select("cell", "category", "population", "lag2")


@query("ml02_column_medians")
def _(t):
    d = t.units().withColumns({"population": F.when(F.col("population") > 0, F.col("population")), "empty": F.lit(None).cast("double")})
    return M.impute_all(d, ["population", "price", "empty"])


@query("ml03_boosted_trees")
def _(t):
    train, test = _split(_panel(t))
    return M.fit_categories(train, test, CATEGORIES, FEATURES).select("cell", "category", "target", "pred")


@query("ml04_feature_ladder")
def _(t):
    train, test = _split(_panel(t))
    return M.ladder(train, test, CATEGORIES, {f"M{i}": FEATURES[:i] for i in range(1, len(FEATURES) + 1)})


def _neighbours(t: Tables):
    """Districts are numbered along a line here: each is next to the one before and the one after."""
    d = t.units().select("district").distinct()
    both = F.explode(F.array(*[F.lpad((F.col("district").cast("int") + i).cast("string"), 6, "0") for i in (-1, 1)]))
    return d.select(F.col("district").alias("a"), both.alias("b"))


@query("ml11_fold_evaluation")
def _(t):
    members = M.split_members(_panel(t), _neighbours(t), [y for y in YEARS if y < TEST_YEAR], TEST_YEAR, 5)
    return M.evaluate_folds(cut_lineage(members), CATEGORIES, FEATURES)


def _regions(t: Tables):
    d = _panel(t)
    source, local = d.filter("district <= '000025'"), d.filter("district > '000025'")
    return source.filter(F.col("year") < TEST_YEAR), local.filter(F.col("year") < TEST_YEAR), local.filter(F.col("year") == TEST_YEAR)


@query("ml13_transfer")
def _(t):
    source, local, test = _regions(t)
    return M.transfer_scores(M.transfer(source, local, test, CATEGORIES, FEATURES))


@query("ml13_rare_capture")
def _(t):
    source, local, test = _regions(t)
    return M.rare_capture(M.transfer(source, local, test, CATEGORIES, FEATURES), CATEGORIES[-1])


@query("ml14_learning_curve")
def _(t):
    source, local, test = _regions(t)
    return M.learning_curve(source, local, test, [1998, 1999], CATEGORIES, FEATURES)


@query("ml15_year_replication")
def _(t):
    return M.year_replication(_panel(t), [1999, 2000], 1997, CATEGORIES, ["population"], FEATURES, "positive")


@query("ml16_grid_tuning")
def _(t):
    return M.tune(_panel(t), [1997, 1998], 1999, TEST_YEAR, CATEGORIES, FEATURES)


@query("ml18_degradation")
def _(t):
    def key(d):
        return F.concat_ws(":", "cell", "year", "category")

    return M.degradation(_panel(t), [0.83, 0.5, 0.25, 0.1, 0.05], 0.83, list(range(10)), [1998, 1999], TEST_YEAR, CATEGORIES, FEATURES, key)


@query("ml22_vector_clusters")
def _(t):
    members = M.cluster_vectors(t.vectors(), 10)
    return members.groupBy("cluster").agg(F.count("*").alias("members"))


@query("ml23_cluster_sweep")
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")

    def describe(members):
        docs = members.groupBy("id").agg(F.collect_list(F.struct("k", "cluster")).alias("groups")).join(texts, "id")
        terms = C.cluster_terms(docs, "id", "text", "cluster", 8, by=["k"], groups="groups")
        return C.flag_clusters(terms, "cluster", ["ouen", "aux", "ung"], ["k"]).select("k", "cluster", "flagged")

    return M.sweep_clusters(t.vectors(), [7, 10, 12, 15], describe, t.labels.filter("quality = 1").select(F.col("doc_id").alias("id")))


@query("ml24_plane_coordinates")
def _(t):
    return M.plane_coordinates(t.vectors())


