"""Joins, windows, panels, surfaces and folds over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.functions.hashing import mixed_hash_sql
from tallyveil.operators import corpus as C
from tallyveil.operators import panel as P
from tallyveil.operators import ranking as RK
from tallyveil.operators import rates as R
from tallyveil.operators import resample as RS
from tallyveil.operators import surface as S
from tallyveil.operators import validation as V
from tallyveil.plans.catalog import CATEGORIES, YEARS, Tables, oracle, query
from tallyveil.session import literal_rows

def _questionnaire(t: Tables):
    """Orders as respondents of a wide questionnaire with two subtypes."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    wide = {"FACTOR": F.when(k % 10 == 0, "").otherwise(F.concat(s(k % 40 + 1), F.lit(",5")))}
    for x in (1, 2):
        wide |= {
            f"P601_{x}": F.when((k + x) % 3 == 0, "1").otherwise("2"), f"P602_{x}": s((k * x) % 60), f"P606_{x}": F.when((k + x) % 2 == 0, "1").otherwise("2"),
            f"P607_{x}": F.when(k % 5 != 0, " 1").otherwise(""), f"P602B_{x}": s(k % 25 + 1), f"P602C_{x}": F.when(k % 4 == 0, "").otherwise("1"),
            f"P602D_{x}_COD": s(k % 43 + 1),
        }
    wide["P602F_1_1_ENT"] = s(k % 7)
    return t.orders.select(k.alias("person"), *[c.alias(n) for n, c in wide.items()])


LONG = """
long AS (
  SELECT person, x AS subtype, weight, CASE WHEN k % 4 <> 0 THEN lpad(CAST(k % 25 + 1 AS VARCHAR), 2, '0') || '01' || lpad(CAST(k % 43 + 1 AS VARCHAR), 2, '0') END AS area,
    times, pnp, CASE WHEN x = '1' THEN least(k % 7, times) ELSE least(pnp, times) END AS pnp_count, least(den, times) AS any_count FROM (
    SELECT o_orderkey AS person, o_orderkey AS k, x, CAST(o_orderkey % 40 + 1 AS DOUBLE) + 0.5 AS weight,
      CASE WHEN (o_orderkey * CAST(x AS BIGINT)) % 60 BETWEEN 1 AND 50 THEN (o_orderkey * CAST(x AS BIGINT)) % 60 ELSE 1 END AS times,
      CASE WHEN (o_orderkey + CAST(x AS BIGINT)) % 2 = 0 THEN 1 ELSE 0 END AS den,
      CASE WHEN (o_orderkey + CAST(x AS BIGINT)) % 2 = 0 AND o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS pnp
    FROM orders CROSS JOIN (VALUES ('1'), ('2')) AS v(x) WHERE o_orderkey % 10 <> 0 AND (o_orderkey + CAST(x AS BIGINT)) % 3 = 0) AS r)"""


def _long(t: Tables):
    return R.unpivot_questionnaire(_questionnaire(t), ["1", "2"], R.QUESTIONNAIRES["classic"], "person", "FACTOR", 2019)


@query("j01_unpivot_questionnaire", oracle("SELECT * FROM long", "", LONG, ints="times pnp pnp_count any_count", dbl="weight"))
def _(t):
    return _long(t).drop("year")


def _new_questionnaire(t: Tables):
    """Orders as respondents of the later questionnaire: other columns, a third subtype, counts for two subtypes."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    wide = {"factor": F.when(k % 9 == 0, "x").otherwise(s(k % 30 + 1))}
    for x in (1, 2, 3):
        wide |= {
            f"P615_{x}": F.when((k + x) % 4 == 0, "1").otherwise("2"), f"P616_{x}": s((k * x) % 55), f"P617_{x}": s(k % 5), f"P619_{x}": F.when((k + x) % 8 == 0, "1").otherwise(""),
            f"P620_{x}": F.when(k % 3 != 0, "1").otherwise("2"), f"P623_{x}_COD": s(k % 25 + 1), f"P624_{x}_COD": s(k % 11 + 1), f"P625_{x}_COD": F.when(k % 7 == 0, "zz").otherwise(s(k % 43 + 1)),
        }
    wide |= {"P618_1_1_ENT": s(k % 4), "P618_3_1_ENT": F.when(k % 2 == 0, "?").otherwise(s(k % 6))}
    return t.orders.select(k.alias("person"), *[c.alias(n) for n, c in wide.items()])


@query("j01_unpivot_both_questionnaires", oracle("""
  SELECT 2019 AS year, * FROM long UNION ALL
  SELECT 2024, person, x AS subtype, weight, CASE WHEN k % 7 <> 0 THEN lpad(CAST(k % 25 + 1 AS VARCHAR), 2, '0') || lpad(CAST(k % 11 + 1 AS VARCHAR), 2, '0') || lpad(CAST(k % 43 + 1 AS VARCHAR), 2, '0') END AS area,
    times, pnp, least(CASE x WHEN '1' THEN k % 4 WHEN '3' THEN CASE WHEN k % 2 = 0 THEN 0 ELSE k % 6 END ELSE pnp END, times) AS pnp_count, least(k % 5, times) AS any_count FROM (
    SELECT o_orderkey AS person, o_orderkey AS k, x, CAST(o_orderkey % 30 + 1 AS DOUBLE) AS weight,
      CASE WHEN (o_orderkey * CAST(x AS BIGINT)) % 55 BETWEEN 1 AND 50 THEN (o_orderkey * CAST(x AS BIGINT)) % 55 ELSE 1 END AS times,
      CASE WHEN (o_orderkey + CAST(x AS BIGINT)) % 8 = 0 AND o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS pnp
    FROM orders CROSS JOIN (VALUES ('1'), ('2'), ('3')) AS v(x) WHERE o_orderkey % 9 <> 0 AND (o_orderkey + CAST(x AS BIGINT)) % 4 = 0) AS r""",
    "", LONG, ints="year times pnp pnp_count any_count", dbl="weight"))
def _(t):
    waves = {2019: _questionnaire(t), 2024: _new_questionnaire(t).withColumnRenamed("factor", "FACTOR")}
    return R.unpivot_waves(waves, {"classic": ["1", "2"], "new": ["1", "2", "3"]}, "person", "FACTOR").withColumn("year", F.col("year").cast("bigint"))


@query("j02_crosswalk_join", oracle(
    "SELECT CASE subtype WHEN '1' THEN 'robo' ELSE 'estafa' END AS category, subtype = '1' AS panel, count(*) AS n, sum(weight) AS weight FROM long GROUP BY ALL",
    "", LONG, ints="n", dbl="weight"))
def _(t):
    crosswalk = literal_rows(t.spark, [("robo", ["1", "6A"], True), ("estafa", ["2"], False)], "category string, codes array<string>, panel boolean")
    return R.attach_category(_long(t), crosswalk, "codes").groupBy("category", "panel").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("j03_observed_rate_population", oracle("""
  SELECT o.area, o.category, o.year, o.observed, r.r_hat, p.population FROM observed o LEFT JOIN rate_rows r ON r.area = o.area AND r.category = o.category
  LEFT JOIN population p ON p.area = o.area AND p.year = o.year""", "observed rate_rows population", ints="year observed population", dbl="r_hat"))
def _(t):
    d = S.attach_rates(t.observed(), t.rate_rows(), t.population())
    return d.select("area", "category", "year", "observed", "r_hat", "population")


@query("j04_panel_zero_fill", oracle("SELECT cell, district, year, category, target FROM panel", "panel", ints="year", dbl="target"))
def _(t):
    d = P.dense_panel(t.units(), YEARS, CATEGORIES)
    return P.zero_filled(d, t.counts(), ["cell", "year", "category"], "count", "target").select("cell", "district", "year", "category", "target")


@query("j05_temporal_lag", oracle("SELECT cell, year, category, persist, lag2 FROM panel", "panel", ints="year", dbl="persist lag2"))
def _(t):
    keys = ["cell", "year", "category"]
    d = P.lagged(P.dense_panel(t.units(), YEARS, CATEGORIES), t.counts(), keys, "count", "persist")
    return P.lagged(d, t.counts(), keys, "count", "lag2", 2).select("cell", "year", "category", "persist", "lag2")


@query("j05_lag_features", oracle("SELECT cell, year, category, target, persist, lag2 FROM panel", "panel", ints="year", dbl="target persist lag2"))
def _(t):
    return t.panel().select("cell", "year", "category", "target", "persist", "lag2")


HEX_COUNTS = """
hex_counts AS (
  SELECT h.cell, year(o_orderdate) AS year, o_orderstatus AS category, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN hexed h ON h.point = o_custkey GROUP BY ALL)"""


def _hex_counts(t: Tables):
    return t.orders.join(t.hexed(), F.col("o_custkey") == F.col("point")).groupBy(
        "cell", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("category")).agg(F.count("*").cast("double").alias("value"))


@query("j06_neighbour_mean", oracle("""
  SELECT h.cell, h.year, h.category, h.value, coalesce(r.m, 0.0) AS ring FROM hex_counts h LEFT JOIN (
    SELECT e.src, c.year, c.category, avg(c.value) AS m FROM ring e JOIN hex_counts c ON c.cell = e.dst GROUP BY ALL) AS r
  ON r.src = h.cell AND r.year = h.year AND r.category = h.category""", "hexed ring", HEX_COUNTS, ints="year", dbl="value ring"))
def _(t):
    return P.neighbour_mean(_hex_counts(t), P.ring_edges(t.cells_hex()), "value", "ring")


@query("j07_full_outer_surfaces", oracle("""
  SELECT coalesce(s.cell, c.cell) AS cell, coalesce(s.category, c.category) AS category, coalesce(s.district, c.district) AS district,
    coalesce(s.observed, 0.0) AS observed, coalesce(c.points, 0.0) AS points
  FROM (SELECT u.cell, category, district, target AS observed FROM scored u WHERE target > 1) AS s
  FULL JOIN (SELECT cell, category, count AS points, '000099' AS district FROM counts WHERE year = 2001 AND category <> 'N') AS c ON c.cell = s.cell AND c.category = s.category""",
    "scored counts", dbl="observed points"))
def _(t):
    s = t.scored().filter("target > 1").select("cell", "category", "district", F.col("target").alias("observed"))
    c = t.counts().filter("year = 2001 AND category <> 'N'").select("cell", "category", F.lit("000099").alias("district"), F.col("count").alias("points"))
    return P.merge_surfaces(s, c, ["cell", "category"], ["observed", "points"])


@query("j08_dense_panel", oracle("SELECT cell, district, year, category FROM panel", "panel", ints="year"))
def _(t):
    return P.dense_panel(t.units().select("cell", "district"), YEARS, CATEGORIES)


@query("j09_total_rows", oracle("""
  SELECT x.area, x.year, x.category, x.observed, p.population FROM (SELECT area, year, category, observed FROM observed UNION ALL
    SELECT area, year, 'TOTAL', sum(observed) FROM observed GROUP BY area, year) AS x LEFT JOIN population p ON p.area = x.area AND p.year = x.year""",
    "observed population", ints="year observed population"))
def _(t):
    return V.with_total(t.observed(), ["area", "year"], ["observed"]).join(t.population(), ["area", "year"], "left")


@query("j10_missing_members", oracle("""
  SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL
  SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""", ints="n"))
def _(t):
    have = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    wanted = t.customer.select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("n"))
    return C.extend_with_missing(have, wanted, "key")


@query("j11_fill_vectors", oracle("""
  SELECT vec_id AS id, 'main' AS origin, embedding[1]::DOUBLE AS first FROM embeddings WHERE label < 8 UNION ALL
  SELECT vec_id, 'local', embedding[1]::DOUBLE FROM embeddings WHERE label = 8""", dbl="first"))
def _(t):
    v = t.vectors()
    main = v.filter("label < 8").select("id", F.lit("main").alias("origin"), "vec")
    local = v.filter("label IN (3, 8)").select("id", F.lit("local").alias("origin"), "vec")
    return C.extend_with_missing(main, local, "id").select("id", "origin", F.col("vec")[0].alias("first"))


@query("j12_membership_flag", oracle("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS selected FROM documents"))
def _(t):
    d = t.documents.select("doc_id", F.lit(False).alias("selected"))
    return C.mark_members(d, t.labels.filter("quality = 1"), "doc_id")


@query("j16_common_key_pairs", oracle("""
  SELECT a.area, a.observed, b.records FROM (SELECT area, sum(observed) AS observed FROM observed WHERE NOT starts_with(area, '02') GROUP BY area) AS a
  JOIN (SELECT area, count(*) AS records FROM records WHERE area IS NOT NULL AND NOT starts_with(area, '01') GROUP BY area) AS b ON a.area = b.area""",
    "observed records", ints="observed records"))
def _(t):
    a = t.observed().filter("NOT startswith(area, '02')").groupBy("area").agg(F.sum("observed").alias("observed"))
    b = t.records().filter("area IS NOT NULL AND NOT startswith(area, '01')").groupBy("area").agg(F.count("*").alias("records"))
    return a.join(b, "area")


@query("j17_paired_models", oracle(
    "SELECT a.category, a.district, a.rho AS rho_a, b.rho AS rho_b FROM rho_persist a JOIN rho_blend b ON a.category = b.category AND a.district = b.district",
    "rho_persist rho_blend", dbl="rho_a rho_b"))
def _(t):
    d = t.scored()
    return RS.pair_models(RK.within_district(d, "persist"), RK.within_district(d, "blend"), "rho")


def _hex_districts(t: Tables):
    tile = (F.floor(F.col("x") / 20) * 5 + F.floor(F.col("y") / 20)).cast("bigint")
    return P.first_per_key(t.hexed().select("cell", "point", tile.alias("district")), "cell", ["point"]).select("cell", "district")


HEX_DISTRICTS = """
hex_district AS (SELECT cell, district FROM (SELECT cell, CAST(floor(x / 20) * 5 + floor(y / 20) AS BIGINT) AS district, row_number() OVER (PARTITION BY cell ORDER BY point) AS rn FROM hexed) AS h WHERE rn = 1),
adjacency AS (SELECT DISTINCT x AS a, y AS b FROM (
  SELECT a.district AS x, b.district AS y FROM ring JOIN hex_district a ON a.cell = src JOIN hex_district b ON b.cell = dst WHERE a.district <> b.district UNION
  SELECT b.district, a.district FROM ring JOIN hex_district a ON a.cell = src JOIN hex_district b ON b.cell = dst WHERE a.district <> b.district) AS p)"""


@query("j18_district_adjacency", oracle("SELECT a, b FROM adjacency", "hexed ring", HEX_DISTRICTS, ints="a b"))
def _(t):
    return P.district_adjacency(P.ring_edges(t.cells_hex()), _hex_districts(t))


WEIGHTS = """
weights AS (
  SELECT cell, district, CASE WHEN sum(population) OVER d > 0 THEN population / sum(population) OVER d ELSE 1.0 / count(*) OVER d END AS weight
  FROM units WINDOW d AS (PARTITION BY district)),
dsurf AS (
  SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 6, '0') AS district, s.year, s.category, s.latent, s.observed * 1.0 AS observed FROM surface s JOIN areas ar ON ar.area = s.area JOIN nation ON n_nationkey = area_key)"""


def _district_surface(t: Tables):
    from tallyveil.functions.codes import zero_pad

    d = t.surface().join(t.areas(), "area")
    return d.select(zero_pad(F.col("area_key") + 1).alias("district"), "year", "category", "latent", F.col("observed").cast("double").alias("observed"))


@query("j19_areal_disaggregation", oracle(
    "SELECT w.cell, w.district, d.year, d.category, d.latent * w.weight AS latent FROM weights w JOIN dsurf d ON d.district = w.district",
    "units surface", WEIGHTS, ints="year", dbl="latent"))
def _(t):
    d = S.disaggregate(S.population_weights(t.units().select("cell", "district", "population")), _district_surface(t), ["latent"])
    return d.select("cell", "district", "year", "category", "latent")


HYBRID = WEIGHTS + """,
pts AS (
  SELECT l_partkey AS cell, CASE WHEN l_suppkey % 10 = 0 THEN '000001' ELSE district END AS district, year(l_shipdate) AS year, l_returnflag AS category, count(*) AS c
  FROM lineitem JOIN units ON cell = l_partkey GROUP BY ALL),
joined AS (
  SELECT w.cell, w.district, w.weight, d.year, d.category, d.latent, coalesce(p.c, 0.0) AS c FROM weights w JOIN dsurf d ON d.district = w.district
  LEFT JOIN pts p ON p.cell = w.cell AND p.district = w.district AND p.year = d.year AND p.category = d.category),
hybrid AS (
  SELECT cell, district, year, category, c, (c + 10.0 * weight) / (sum(c) OVER g + 10.0) AS share, latent * (c + 10.0 * weight) / (sum(c) OVER g + 10.0) AS latent
  FROM joined WINDOW g AS (PARTITION BY district, year, category))"""


def _border_points(t: Tables):
    d = t.lineitem.join(t.units(), F.col("l_partkey") == F.col("cell"))
    return d.select("cell", F.when(F.col("l_suppkey") % 10 == 0, "000001").otherwise(F.col("district")).alias("district"),
                    F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("category"), F.lit(1).alias("count"))


def _hybrid(t: Tables):
    w = S.population_weights(t.units().select("cell", "district", "population"))
    return S.hybrid_surface(w, _district_surface(t), _border_points(t), ["latent"])


@query("j20_border_safe_join", oracle("SELECT cell, district, year, category, c AS points FROM joined", "units surface", HYBRID, ints="year", dbl="points"))
def _(t):
    w = S.population_weights(t.units().select("cell", "district", "population")).join(_district_surface(t), "district")
    pts = P.point_counts(_border_points(t), ["cell", "district", "year", "category"])
    d = P.zero_filled(w, pts, ["cell", "district", "year", "category"], "count", "points")
    return d.select("cell", "district", "year", "category", "points")


@query("j21_short_labels", oracle("""
  SELECT a.area, coalesce(l.label, substr(a.area, 4, 3)) AS label, a.observed FROM (SELECT area, sum(observed) AS observed FROM observed GROUP BY area) AS a
  LEFT JOIN (VALUES ('010101', 'Uno'), ('020201', 'Dos')) AS l(area, label) ON l.area = a.area""", "observed", ints="observed"))
def _(t):
    labels = literal_rows(t.spark, [("010101", "Uno"), ("020201", "Dos")], "area string, label string")
    d = t.observed().groupBy("area").agg(F.sum("observed").alias("observed"))
    return d.join(labels, "area", "left").withColumn("label", F.coalesce("label", F.substring("area", 4, 3)))


@query("j22_listed_areas", oracle("""
  SELECT a.area, c.category, coalesce(p.n_eff, 0.0) AS n_eff FROM areas a CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS c(category)
  LEFT JOIN (SELECT * FROM pooled WHERE NOT starts_with(area, '03')) AS p ON p.area = a.area AND p.category = c.category""", "areas pooled", dbl="n_eff"))
def _(t):
    seen = t.pooled().filter("NOT startswith(area, '03')")
    return R.on_area_list(seen, t.areas(), CATEGORIES).select("area", "category", "n_eff")


# ---- windows ------------------------------------------------------------------------

@query("w01_share_in_group", oracle(
    "SELECT cell, category, CASE WHEN sum(persist) OVER d > 0 THEN persist / sum(persist) OVER d ELSE 0.0 END AS share FROM scored WINDOW d AS (PARTITION BY district, category)",
    "scored", dbl="share"))
def _(t):
    return P.share_in_group(t.scored(), ["district", "category"], "persist", "share").select("cell", "category", "share")


@query("w02_population_weight", oracle("SELECT cell, district, weight FROM weights", "units surface", WEIGHTS, dbl="weight"))
def _(t):
    return S.population_weights(t.units().select("cell", "district", "population")).select("cell", "district", "weight")


@query("w03_dirichlet_share", oracle(
    "SELECT cell, category, (target + 10.0 * p) / (sum(target) OVER d + 10.0) AS share FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY district, category) AS p FROM scored) AS s WINDOW d AS (PARTITION BY district, category)",
    "scored", dbl="share"))
def _(t):
    d = t.scored()
    n = d.groupBy("district", "category").agg((1.0 / F.count("*")).alias("p"))
    return S.dirichlet_share(d.join(n, ["district", "category"]), ["district", "category"], "target", "p", 10.0).select("cell", "category", "share")


@query("w04_dominant_label", oracle("""
  SELECT cell, label FROM (SELECT l_partkey AS cell, l_returnflag AS label, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_returnflag DESC) AS rn
    FROM lineitem GROUP BY l_partkey, l_returnflag) AS r WHERE rn = 1"""))
def _(t):
    d = t.lineitem.select(F.col("l_partkey").alias("cell"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("v"))
    return P.dominant_label(d, "cell", "label", "v")


@query("w05_rank_shift", oracle("""
  SELECT category, cell, row_number() OVER (PARTITION BY category ORDER BY target DESC, cell) AS rank_a, row_number() OVER (PARTITION BY category ORDER BY blend DESC, cell) AS rank_b,
    row_number() OVER (PARTITION BY category ORDER BY target DESC, cell) - row_number() OVER (PARTITION BY category ORDER BY blend DESC, cell) AS shift FROM scored WHERE population > 0""",
    "scored", ints="rank_a rank_b shift"))
def _(t):
    return RK.rank_shift(t.scored().filter("population > 0"), ["category"], "target", "blend", "cell").select("category", "cell", "rank_a", "rank_b", "shift")


@query("w06_ordinal_rank", oracle("""
  SELECT category, max(abs(ra - rb)) AS max_shift, corr(ra, rb) AS rho, count(*) AS n FROM (
    SELECT category, row_number() OVER (PARTITION BY category ORDER BY target DESC, cell) AS ra, row_number() OVER (PARTITION BY category ORDER BY blend DESC, cell) AS rb FROM scored) AS r GROUP BY category""",
    "scored", ints="max_shift n", dbl="rho"))
def _(t):
    d = RK.rank_shift(t.scored(), ["category"], "target", "blend", "cell")
    return d.groupBy("category").agg(F.max(F.abs("shift")).alias("max_shift"), F.corr("rank_a", "rank_b").alias("rho"), F.count("*").alias("n"))


LADDER = """
steps AS (
  SELECT o_orderpriority AS model, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS step, substr(o_orderpriority, 1, 1) <> '3' AS is_ladder, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY ALL)"""


def _ladder(t: Tables):
    p = F.col("o_orderpriority")
    return t.orders.groupBy(p.alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("score")).withColumns(
        {"step": F.substring("model", 1, 1).cast("bigint"), "is_ladder": F.substring("model", 1, 1) != "3"})


@query("w07_marginal_ladder", oracle("""
  SELECT model, step, is_ladder, score, CASE WHEN is_ladder THEN score - last_value(CASE WHEN is_ladder THEN score END IGNORE NULLS)
    OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS delta FROM steps""", "", LADDER, dbl="score delta", digits=3), digits=3)
def _(t):
    return RS.rolling_reference(_ladder(t), "step", "score", "is_ladder")


@query("w08_model_comparison", oracle("""
  SELECT h.model AS hi, l.model AS lo, h.score - l.score AS delta, (SELECT arg_max(model, score) FROM steps) AS best FROM steps h JOIN steps l ON l.step = h.step + 1""",
    "", LADDER, dbl="delta", digits=3), digits=3)
def _(t):
    s = _ladder(t)
    lo = s.select((F.col("step") - 1).alias("step"), F.col("model").alias("lo"), F.col("score").alias("_l"))
    best = s.agg(F.max_by("model", "score").alias("best"))
    return s.join(lo, "step").crossJoin(best).select(F.col("model").alias("hi"), "lo", (F.col("score") - F.col("_l")).alias("delta"), "best")


@query("w09_placebo_permutation", oracle(f"""
  SELECT r.category, r.district, r.cell, g.target AS placebo FROM (SELECT *, row_number() OVER (PARTITION BY category, district ORDER BY cell) AS rn FROM scored) AS r
  JOIN (SELECT *, row_number() OVER (PARTITION BY category, district ORDER BY {mixed_hash_sql('cell', 11)}, cell) AS rn FROM scored) AS g
    ON g.category = r.category AND g.district = r.district AND g.rn = r.rn""", "scored", dbl="placebo"))
def _(t):
    return RS.placebo_permutation(t.scored(), ["category", "district"], "cell", "target", 11)


@query("s01_union_of_panels", oracle("SELECT cell, category, target FROM scored UNION ALL SELECT cell, 'ALL', sum(target) FROM scored GROUP BY cell", "scored", dbl="target"))
def _(t):
    d = t.scored().select("cell", "category", "target")
    return d.unionByName(d.groupBy("cell").agg(F.sum("target").alias("target")).withColumn("category", F.lit("ALL")))


@query("s02_deduplicate_identifiers", oracle(
    "SELECT key, page_id, url FROM (SELECT regexp_extract(lower(url), '^https?://[^/]+') AS key, page_id, url, row_number() OVER (PARTITION BY regexp_extract(lower(url), '^https?://[^/]+') ORDER BY page_id) AS rn FROM pages) AS p WHERE rn = 1"))
def _(t):
    d = t.pages.select(F.regexp_extract(F.lower("url"), "^https?://[^/]+", 0).alias("key"), "page_id", "url")
    return P.first_per_key(d, "key", ["page_id"])


@query("s03_first_district", oracle("SELECT cell, district FROM hex_district", "hexed ring", HEX_DISTRICTS, ints="district"))
def _(t):
    return _hex_districts(t)


def folds_sql(table: str, key: str, folds: int, seed: int) -> str:
    return f"""SELECT {key}, CASE WHEN i < (n % {folds}) * ceil(n / {folds}.0) THEN floor(i / ceil(n / {folds}.0)) ELSE n % {folds} + floor((i - (n % {folds}) * ceil(n / {folds}.0)) / greatest(floor(n / {folds}.0), 1)) END AS fold
    FROM (SELECT {key}, row_number() OVER (ORDER BY {mixed_hash_sql(key, seed)}, {key}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table}) AS u) AS o"""


MEMBERS = f"""
dist AS (SELECT cell, district FROM hex_district),
dfold AS ({folds_sql('dist', 'district', 5, 42)}),
members AS (SELECT d.cell, d.district, k.fold AS fold, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS part FROM dist d JOIN dfold f ON f.district = d.district CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(fold))"""


def _members(t: Tables):
    d = _hex_districts(t)
    return P.membership(d, P.seeded_folds(d, "district", 5, 42), "district", 5)


@query("s04_fold_membership", oracle("SELECT cell, district, fold, part FROM members", "hexed ring", HEX_DISTRICTS + "," + MEMBERS, ints="district fold"))
def _(t):
    return _members(t).select("cell", "district", "fold", "part")


@query("ml07_temporal_hold_out", oracle(
    "SELECT part, year, count(*) AS n FROM (SELECT year, CASE WHEN year BETWEEN 1996 AND 1999 THEN 'train' WHEN year = 2000 THEN 'test' END AS part FROM panel) AS p WHERE part IS NOT NULL GROUP BY part, year",
    "panel", ints="year n"))
def _(t):
    return P.hold_out(t.panel(), [1996, 1997, 1998, 1999], 2000).groupBy("part", "year").agg(F.count("*").alias("n"))


@query("ml08_random_folds", oracle(folds_sql("units", "cell", 5, 42), "units", ints="fold"))
def _(t):
    return P.seeded_folds(t.units(), "cell", 5, 42)


@query("ml09_grouped_folds", oracle("SELECT district, fold FROM dfold", "hexed ring", HEX_DISTRICTS + "," + MEMBERS, ints="district fold"))
def _(t):
    return P.seeded_folds(_hex_districts(t), "district", 5, 42)


@query("ml10_buffered_folds", oracle("""
  SELECT m.cell, m.district, m.fold, m.part FROM members m WHERE NOT (m.part = 'train' AND EXISTS (
    SELECT 1 FROM adjacency a JOIN dfold f ON f.district = a.b WHERE a.a = m.district AND f.fold = m.fold))""", "hexed ring", HEX_DISTRICTS + "," + MEMBERS, ints="district fold"))
def _(t):
    adj = P.district_adjacency(P.ring_edges(t.cells_hex()), _hex_districts(t))
    return P.buffered_membership(_members(t), adj).select("cell", "district", "fold", "part")


@query("ml12_district_hold_out", oracle(f"""
  SELECT district, CASE WHEN rn <= greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS part FROM (
    SELECT district, row_number() OVER (ORDER BY {mixed_hash_sql('district', 7)}, district) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT district FROM hex_district) AS d) AS r""",
    "hexed ring", HEX_DISTRICTS, ints="district"))
def _(t):
    return P.district_hold_out(_hex_districts(t), "district", 7)


THIN_KEY = "((cell * 7 + year) * 3 + (ascii(category) % 3))"


@query("ml17_binomial_thinning", oracle(f"""
  SELECT cell, year, category, target, CAST(len(list_filter(range(1, CAST(target AS BIGINT) + 1), lambda i: ({mixed_hash_sql(THIN_KEY, 2025, 'i')}) / 4294967296.0 < 0.25 / 0.83)) AS DOUBLE) AS thin FROM panel""",
    "panel", ints="year", dbl="target thin"))
def _(t):
    key = (F.col("cell") * 7 + F.col("year")) * 3 + F.ascii("category") % 3
    return P.thin_counts(t.panel(), key, "target", "thin", 0.25, 0.83, 2).select("cell", "year", "category", "target", "thin")


@query("ml19_population_surface", oracle(
    "SELECT w.cell, w.district, d.year, d.category, d.latent * w.weight AS latent, d.observed * w.weight AS observed FROM weights w JOIN dsurf d ON d.district = w.district",
    "units surface", WEIGHTS, ints="year", dbl="latent observed"))
def _(t):
    d = S.disaggregate(S.population_weights(t.units().select("cell", "district", "population")), _district_surface(t), ["latent", "observed"])
    return d.select("cell", "district", "year", "category", "latent", "observed")


@query("ml20_hybrid_surface", oracle("SELECT cell, district, year, category, share AS weight, latent FROM hybrid", "units surface", HYBRID, ints="year", dbl="weight latent"))
def _(t):
    return _hybrid(t).select("cell", "district", "year", "category", "weight", "latent")


@query("ml21_city_panel", oracle("""
  SELECT u.cell, y.year AS year, k.category AS category, coalesce(dm.district, '0401XX') AS district, coalesce(c.n, 0.0) AS target, coalesce(l.n, 0.0) AS persist
  FROM units u CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) AS y CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS k(category)
  LEFT JOIN (SELECT cell, district FROM (SELECT cell, district, row_number() OVER (PARTITION BY cell ORDER BY sum(c) DESC, district DESC) AS rn FROM pts GROUP BY cell, district) AS r WHERE rn = 1) AS dm ON dm.cell = u.cell
  LEFT JOIN (SELECT cell, year, category, CAST(sum(c) AS DOUBLE) AS n FROM pts GROUP BY ALL) AS c ON c.cell = u.cell AND c.year = y.year AND c.category = k.category
  LEFT JOIN (SELECT cell, year + 1 AS year, category, CAST(sum(c) AS DOUBLE) AS n FROM pts GROUP BY ALL) AS l ON l.cell = u.cell AND l.year = y.year AND l.category = k.category
  WHERE dm.district IS NOT NULL OR u.population > 0""", "units surface", HYBRID, ints="year", dbl="target persist"))
def _(t):
    points = _border_points(t).groupBy("cell", "district", "year", "category").agg(F.count("*").alias("count"))
    d = P.city_panel(points, t.units().select("cell", "population", "district"), YEARS, CATEGORIES, "0401XX")
    return d.select("cell", "year", "category", "district", "target", "persist")


@query("m35_point_counts", oracle(
    "SELECT cell, nation AS district, year(o_orderdate) AS year, o_orderstatus AS category, count(*) AS count FROM orders JOIN hexed ON point = o_custkey GROUP BY ALL",
    "hexed", ints="district year count"))
def _(t):
    d = t.orders.join(t.hexed(), F.col("o_custkey") == F.col("point")).select(
        "cell", F.col("nation").alias("district"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("category"))
    return P.point_counts(d, ["cell", "district", "year", "category"])


@query("m36_pixel_density", oracle(
    "SELECT cell, sum(value) AS total, sum(value) / (1.5 * 1.7320508075688772 * 16.0) AS density FROM hexed GROUP BY cell", "hexed", dbl="total density", digits=4), digits=4)
def _(t):
    return P.pixel_density(t.hexed(), "value", 4.0)


@query("m32_coordinate_rate", oracle(
    "SELECT nation AS province, count(*) AS records, avg(CASE WHEN x BETWEEN 1 AND 99 AND y BETWEEN 1 AND 99 THEN 1.0 ELSE 0.0 END) AS rate FROM points GROUP BY nation",
    "points", ints="province records", dbl="rate"))
def _(t):
    d = t.points().select(F.col("nation").alias("province"), (F.col("x").between(1, 99) & F.col("y").between(1, 99)).alias("has_point"))
    return P.coordinate_rate(d, "province", "has_point")


