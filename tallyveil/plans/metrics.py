"""Ranking metrics, resampling and agreement over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.functions.hashing import mixed_hash_sql, string_code_sql
from tallyveil.operators import panel as P
from tallyveil.operators import ranking as RK
from tallyveil.operators import resample as RS
from tallyveil.operators import screening as SC
from tallyveil.operators import surface as S
from tallyveil.operators import validation as V
from tallyveil.operators.models import baselines
from tallyveil.plans.catalog import CATEGORIES, TEST_YEAR, Tables, oracle, query
from tallyveil.session import literal_rows

REPS = 2000


def rank_sql(c: str, by: str, desc: bool = False) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


def global_rho(pred: str, table: str = "scored", target: str = "target", by: str = "category") -> str:
    return f"""SELECT {by}, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho, count(*) AS n FROM (
      SELECT {by}, {rank_sql(pred, by)} AS rx, {rank_sql(target, by)} AS ry FROM {table}) AS r GROUP BY {by}"""


@query("m01_spearman", oracle(global_rho("blend"), "scored", ints="n", dbl="rho"))
def _(t):
    return RK.spearman(t.scored(), ["category"], "blend", "target")


@query("m02_guarded_spearman", oracle(
    global_rho("p", "(SELECT district, CASE WHEN district < '000010' THEN 1.0 ELSE persist END AS p, target FROM scored WHERE population > 0) AS g", by="district"),
    "scored", ints="n", dbl="rho"))
def _(t):
    p = F.when(F.col("district") < "000010", 1.0).otherwise(F.col("persist"))
    y = F.when(F.col("population") > 0, F.col("target")).otherwise(F.lit(float("nan")))
    return RK.spearman(t.scored().select("district", p.alias("p"), y.alias("y")), ["district"], "p", "y")


@query("m04_within_district_spearman", oracle("SELECT * FROM rho_blend", "rho_blend", ints="n", dbl="rho"))
def _(t):
    return RK.within_district(t.scored(), "blend")


@query("m05_macro_mean", oracle(
    "SELECT avg(m) AS macro_rho, count(m) AS categories FROM (SELECT category, avg(rho) AS m FROM rho_blend GROUP BY category) AS c", "rho_blend", ints="categories", dbl="macro_rho"))
def _(t):
    return RK.macro(RK.within_district(t.scored(), "blend"), "rho")


def capture_sql(pred: str, by: str, k: str, table: str = "scored", target: str = "target") -> str:
    return f"""SELECT {by}, count(*) AS n_cells, max(k) AS k, CASE WHEN sum({target}) > 0 THEN sum(CASE WHEN rn <= k THEN {target} ELSE 0.0 END) / sum({target}) END AS capture FROM (
      SELECT *, greatest(1, {k}) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {pred} DESC, cell) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {table}) AS a) AS b GROUP BY {by}"""


K_ROUND, K_CEIL = "round_even(0.10 * n, 0)", "ceil(round(0.10 * n, 9))"


@query("m06_capture_in_district", oracle(
    capture_sql("persist", "category, district", K_ROUND, "(SELECT s.* FROM scored s SEMI JOIN supported_persist p ON p.category = s.category AND p.district = s.district) AS q"),
    "scored supported_persist", ints="n_cells k", dbl="capture"))
def _(t):
    d = RK.keep_supported(t.scored(), ["category", "district"], "persist", "target")
    return RK.top_share(d, ["category", "district"], "persist", "target", "cell", "round")


@query("m07_global_capture", oracle(capture_sql("blend", "category", K_CEIL), "scored", ints="n_cells k", dbl="capture"))
def _(t):
    return RK.top_share(t.scored(), ["category"], "blend", "target", "cell", "ceil")


PER_CAPITA = """
pc AS (SELECT cell, category, district, target / population AS target, blend / population AS blend FROM scored WHERE population > 0),
pc_ok AS (SELECT category, district FROM pc GROUP BY ALL HAVING count(*) >= 5 AND min(target) < max(target) AND min(blend) < max(blend)),
pc_kept AS (SELECT pc.* FROM pc SEMI JOIN pc_ok ON pc_ok.category = pc.category AND pc_ok.district = pc.district)"""


@query("m08_per_capita", oracle(global_rho("blend", "pc_kept", by="category, district"), "scored", PER_CAPITA, ints="n", dbl="rho"))
def _(t):
    return RK.within_district(RK.per_capita(t.scored(), ["target", "blend"]), "blend")


PREDICTIONS = f"""
oracle_rows AS (SELECT s.cell, s.district, s.category, s.target, coalesce(p.count, 0.0) AS pred FROM scored s
  LEFT JOIN (SELECT * FROM counts WHERE year = {TEST_YEAR - 2} AND count > 1) AS p ON p.cell = s.cell AND p.category = s.category),
ok_rows AS (SELECT category, district FROM oracle_rows GROUP BY ALL HAVING count(*) >= 5 AND min(target) < max(target) AND min(pred) < max(pred)),
kept_rows AS (SELECT o.* FROM oracle_rows o SEMI JOIN ok_rows k ON k.category = o.category AND k.district = o.district),
oracle_rho AS ({global_rho("pred", "kept_rows", by="category, district")})"""


@query("m09_oracle_evaluation", oracle(
    "SELECT category, avg(rho) AS rho, count(*) AS districts FROM oracle_rho GROUP BY category", "scored counts", PREDICTIONS, ints="districts", dbl="rho"))
def _(t):
    p = t.counts().filter((F.col("year") == TEST_YEAR - 2) & (F.col("count") > 1)).withColumnRenamed("count", "p")
    d = P.zero_filled(t.scored().select("cell", "district", "category", "target"), p, ["cell", "category"], "p", "pred")
    return RK.within_district(d, "pred").groupBy("category").agg(F.avg("rho").alias("rho"), F.count("*").alias("districts"))


def pack_sql(pred: str, rho: str, model: str | None = None) -> str:
    extra = f", '{model}' AS model" if model else ""
    return f"""
  SELECT b.category, b.n_cells, b.target_sum, b.pred_sum, b.nmae, g.rho AS spearman_global, r.capture AS recall10, d.ndcg, i.intra_spearman, i.intra_districts,
    l.m AS intra_recall10, l.m / 0.10 AS intra_pai{extra}
  FROM (SELECT category, count(*) AS n_cells, sum(target) AS target_sum, sum({pred}) AS pred_sum, sum(abs({pred} - target)) / sum(target) AS nmae FROM scored GROUP BY category HAVING sum(target) > 0) AS b
  LEFT JOIN ({global_rho(pred)}) AS g USING (category) LEFT JOIN ({capture_sql(pred, 'category', K_CEIL)}) AS r USING (category)
  LEFT JOIN (SELECT category, sum(target / log2(rp + 1)) / sum(target / log2(rt + 1)) AS ndcg FROM (
    SELECT category, target, row_number() OVER (PARTITION BY category ORDER BY {pred} DESC, cell) AS rp, row_number() OVER (PARTITION BY category ORDER BY target DESC, cell) AS rt FROM scored) AS n GROUP BY category) AS d USING (category)
  LEFT JOIN (SELECT category, avg(rho) AS intra_spearman, count(*) AS intra_districts FROM {rho} GROUP BY category) AS i USING (category)
  LEFT JOIN (SELECT category, avg(capture) AS m FROM ({capture_sql(pred, 'category, district', K_ROUND)}) AS c GROUP BY category) AS l USING (category)"""


PACK_INTS = "n_cells intra_districts"
PACK_DBL = "target_sum pred_sum nmae spearman_global recall10 ndcg intra_spearman intra_recall10 intra_pai"


@query("m10_metric_pack", oracle(pack_sql("blend", "rho_blend"), "scored rho_blend", ints=PACK_INTS, dbl=PACK_DBL))
def _(t):
    return RK.metric_pack(t.scored(), "blend")


@query("m11_global_recall", oracle(f"SELECT category, capture AS recall10 FROM ({capture_sql('persist', 'category', K_CEIL)}) AS c", "scored", dbl="recall10"))
def _(t):
    return RK.top_share(t.scored(), ["category"], "persist", "target", "cell", "ceil").select("category", F.col("capture").alias("recall10"))


@query("m12_intra_recall", oracle(
    f"SELECT category, avg(capture) AS intra_recall10 FROM ({capture_sql('persist', 'category, district', K_ROUND)}) AS c GROUP BY category", "scored", dbl="intra_recall10"))
def _(t):
    d = RK.top_share(t.scored(), ["category", "district"], "persist", "target", "cell", "round")
    return d.groupBy("category").agg(F.avg("capture").alias("intra_recall10"))


@query("m13_prediction_accuracy_index", oracle(
    f"SELECT category, avg(capture) / 0.10 AS intra_pai FROM ({capture_sql('blend', 'category, district', K_ROUND)}) AS c GROUP BY category", "scored", dbl="intra_pai"))
def _(t):
    d = RK.top_share(t.scored(), ["category", "district"], "blend", "target", "cell", "round")
    return d.groupBy("category").agg((F.avg("capture") / 0.10).alias("intra_pai"))


@query("m14_ndcg", oracle("""
  SELECT category, district, CASE WHEN sum(target / log2(rt + 1)) > 0 THEN sum(target / log2(rp + 1)) / sum(target / log2(rt + 1)) END AS ndcg FROM (
    SELECT category, district, target, row_number() OVER (PARTITION BY category, district ORDER BY blend DESC, cell) AS rp, row_number() OVER (PARTITION BY category, district ORDER BY target DESC, cell) AS rt
    FROM scored) AS n GROUP BY category, district""", "scored", dbl="ndcg"))
def _(t):
    return RK.ndcg(t.scored(), ["category", "district"], "blend", "target", "cell")


@query("m15_normalised_error", oracle(
    "SELECT category, district, CASE WHEN sum(target) > 0 THEN sum(abs(blend - target)) / sum(target) END AS nmae FROM scored GROUP BY ALL", "scored", dbl="nmae", digits=12), digits=12)
def _(t):
    return RK.nmae(t.scored(), ["category", "district"], "blend", "target").select("category", "district", "nmae")


@query("m16_macro_average", oracle("""
  SELECT avg(rho) AS macro_rho, (SELECT avg(nmae) FROM (SELECT category, sum(abs(blend - target)) / sum(target) AS nmae FROM scored GROUP BY category) AS e) AS macro_nmae FROM (
  """ + global_rho("blend") + ") AS g", "scored", dbl="macro_rho macro_nmae"))
def _(t):
    d = t.scored()
    both = RK.spearman(d, ["category"], "blend", "target").join(RK.nmae(d, ["category"], "blend", "target"), "category")
    return both.agg(F.avg("rho").alias("macro_rho"), F.avg("nmae").alias("macro_nmae"))


@query("m17_overlap_at_k", oracle("""
  SELECT category, district, n AS n_cells, k, mae, hits * 1.0 / nullif(k, 0) AS overlap FROM (
    SELECT category, district, count(*) AS n, max(k) AS k, avg(abs(blend - target)) AS mae, sum(CASE WHEN rp <= k AND rt <= k THEN 1 ELSE 0 END) AS hits FROM (
      SELECT *, least(100, n // 5) AS k FROM (SELECT *, count(*) OVER (PARTITION BY category, district) AS n, row_number() OVER (PARTITION BY category, district ORDER BY blend DESC, cell) AS rp,
        row_number() OVER (PARTITION BY category, district ORDER BY target DESC, cell) AS rt FROM scored) AS a) AS b GROUP BY category, district) AS c WHERE n >= 5""",
    "scored", ints="n_cells k", dbl="mae overlap"))
def _(t):
    return RK.overlap_at_k(t.scored(), ["category", "district"], "blend", "target", "cell")


# ---- bootstrap ----------------------------------------------------------------------

def boot_sql(stats: str, group: str, unit: str, value: str, reps: int, seed: int = 0) -> str:
    """Resampled group means as SQL: same hash, same draws."""
    return f"""
  placed AS (SELECT {group} AS grp, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {unit}) AS pos, count(*) OVER (PARTITION BY {group}) AS n FROM {stats} WHERE {value} IS NOT NULL),
  coded AS (SELECT *, {string_code_sql('grp')} AS code FROM placed),
  drawn AS (SELECT c.grp, r.rep, CAST(floor({mixed_hash_sql('r.rep', f'(c.code + {seed})', 'c.pos')} * c.n / 4294967296.0) AS BIGINT) + 1 AS pick
    FROM coded c CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep) AS r),
  means AS (SELECT d.grp, d.rep, avg(p.v) AS m FROM drawn d JOIN placed p ON p.grp = d.grp AND p.pos = d.pick GROUP BY d.grp, d.rep)"""


INTERVAL = "quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, count(m) AS replicates"
MACRO_INTERVAL = f"SELECT (SELECT avg(m) FROM (SELECT grp, avg(v) AS m FROM placed GROUP BY grp) AS a) AS point, {INTERVAL} FROM (SELECT rep, avg(m) AS m FROM means GROUP BY rep) AS d"
PAIRED = """paired AS (SELECT a.category, a.district, a.rho AS rho_a, b.rho AS rho_b, b.rho - a.rho AS delta FROM rho_persist a JOIN rho_blend b ON a.category = b.category AND a.district = b.district)"""


@query("m18_bootstrap_macro", oracle(MACRO_INTERVAL, "rho_blend", boot_sql("rho_blend", "category", "district", "rho", 2000), ints="replicates", dbl="point ci_low ci_high"))
def _(t):
    return RS.bootstrap_macro(RK.within_district(t.scored(), "blend"), "rho")


def _paired(t: Tables):
    d = t.scored()
    return RS.pair_models(RK.within_district(d, "persist"), RK.within_district(d, "blend"), "rho")


@query("m19_paired_bootstrap", oracle(
    MACRO_INTERVAL, "rho_persist rho_blend", PAIRED + "," + boot_sql("paired", "category", "district", "delta", 2000), ints="replicates", dbl="point ci_low ci_high"))
def _(t):
    return RS.bootstrap_delta(_paired(t), "rho")


BY_CATEGORY = f"""
  SELECT p.category, p.districts, CASE WHEN districts >= 2 THEN p.point END AS point, CASE WHEN districts >= 2 THEN i.ci_low END AS ci_low, CASE WHEN districts >= 2 THEN i.ci_high END AS ci_high
  FROM (SELECT category, avg(delta) AS point, count(*) AS districts FROM paired GROUP BY category) AS p JOIN (SELECT grp, {INTERVAL} FROM means GROUP BY grp) AS i ON i.grp = p.category"""


@query("m20_category_bootstrap", oracle(
    BY_CATEGORY, "rho_persist rho_blend", PAIRED + "," + boot_sql("paired", "category", "district", "delta", REPS), ints="districts", dbl="point ci_low ci_high"))
def _(t):
    return RS.bootstrap_by_category(_paired(t), "rho", replicates=REPS)


# Design cells: order priority is the label, order status the fusion, order year and month the seed.
DESIGN = """
design AS (SELECT o_orderstatus || CASE WHEN o_orderpriority < '3' THEN '-high' ELSE '-low' END AS cell, year(o_orderdate) * 12 + month(o_orderdate) AS seed, round(avg(o_totalprice) / 1000.0, 6) AS score
  FROM orders GROUP BY ALL HAVING count(*) > 0),
seeds AS (SELECT cell, seed, CASE WHEN seed % 17 = 0 THEN NULL ELSE score END AS score FROM design)"""


def _design(t: Tables):
    cell = F.concat("o_orderstatus", F.when(F.col("o_orderpriority") < "3", "-high").otherwise("-low"))
    d = t.orders.groupBy(cell.alias("cell"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("seed")).agg(F.round(F.avg("o_totalprice") / 1000.0, 6).alias("score"))
    return d.withColumn("score", F.when(F.col("seed") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


CONTRAST = """
contrast AS (SELECT 'F high-low' AS contrast, h.seed, h.score - l.score AS delta FROM seeds h JOIN seeds l ON l.seed = h.seed AND l.cell = 'F-low' WHERE h.cell = 'F-high' AND h.score IS NOT NULL AND l.score IS NOT NULL),
second AS (SELECT h.seed, h.score - l.score AS delta FROM seeds h JOIN seeds l ON l.seed = h.seed AND l.cell = 'O-low' WHERE h.cell = 'O-high' AND h.score IS NOT NULL AND l.score IS NOT NULL),
inter AS (SELECT 'interaction' AS contrast, a.seed, a.delta - b.delta AS delta FROM contrast a JOIN second b ON b.seed = a.seed)"""
PAIRS_SQL = f"SELECT c.contrast, c.point, c.pairs, i.ci_low, i.ci_high, i.replicates FROM (SELECT contrast, avg(delta) AS point, count(*) AS pairs FROM {{0}} GROUP BY contrast) AS c JOIN (SELECT grp, {INTERVAL} FROM means GROUP BY grp) AS i ON i.grp = c.contrast"


@query("m21_seed_bootstrap", oracle(
    PAIRS_SQL.format("contrast"), "", DESIGN + "," + CONTRAST + "," + boot_sql("contrast", "contrast", "seed", "delta", REPS), ints="pairs replicates", dbl="point ci_low ci_high", digits=5), digits=5)
def _(t):
    return RS.bootstrap_pairs(RS.paired_contrast(_design(t), "cell", "seed", "score", "F-high", "F-low"), "F high-low", "seed", REPS)


@query("m22_replication_flags", oracle(f"""
  SELECT *, ci_low > 0 OR ci_high < 0 AS significant, CASE WHEN category = 'A' THEN ci_low > 0 WHEN category = 'N' THEN ci_high < 0 ELSE ci_low <= 0 AND ci_high >= 0 END AS replicates_expected FROM ({BY_CATEGORY}) AS b""",
    "rho_persist rho_blend", PAIRED + "," + boot_sql("paired", "category", "district", "delta", REPS), ints="districts", dbl="point ci_low ci_high"))
def _(t):
    d = RS.significance(RS.bootstrap_by_category(_paired(t), "rho", replicates=REPS))
    return RS.replication(d, F.when(F.col("category") == "A", "positive").when(F.col("category") == "N", "negative").otherwise("ns"))


SPLIT = """
quality AS (SELECT district, avg(CASE WHEN population > 950 THEN 1.0 ELSE 0.0 END) AS ratio FROM units GROUP BY district),
halves AS (SELECT q.district, CASE WHEN ratio >= (SELECT median(ratio) FROM quality) THEN 'high' ELSE 'low' END AS half FROM quality q)"""


@query("m23_median_split", oracle("""
  SELECT half, avg(m) AS macro_rho, sum(n) AS districts FROM (SELECT half, category, avg(rho) AS m, count(*) AS n FROM rho_blend JOIN halves USING (district) GROUP BY half, category) AS c GROUP BY half""",
    "rho_blend units", SPLIT, ints="districts", dbl="macro_rho"))
def _(t):
    quality = t.units().groupBy("district").agg(F.avg((F.col("population") > 950).cast("double")).alias("ratio"))
    halves = RS.median_split(RK.within_district(t.scored(), "blend"), quality)
    per = halves.groupBy("half", "category").agg(F.avg("rho").alias("m"), F.count("*").alias("n"))
    return per.groupBy("half").agg(F.avg("m").alias("macro_rho"), F.sum("n").alias("districts"))


@query("m24_design_cell_means", oracle(
    "SELECT cell, avg(score) AS mean, stddev_samp(score) AS sd, count(score) AS n FROM seeds GROUP BY cell", "", DESIGN, ints="n", dbl="mean sd", digits=5), digits=5)
def _(t):
    return RS.cell_summary(_design(t), ["cell"], "score")


@query("m25_factorial_interaction", oracle(
    PAIRS_SQL.format("inter"), "", DESIGN + "," + CONTRAST + "," + boot_sql("inter", "contrast", "seed", "delta", REPS), ints="pairs replicates", dbl="point ci_low ci_high", digits=5), digits=5)
def _(t):
    d = RS.interaction(_design(t), "cell", "seed", "score", ("F-high", "F-low"), ("O-high", "O-low"))
    return RS.bootstrap_pairs(d, "interaction", "seed", REPS)


@query("m26_dose_response", oracle(
    "SELECT l_linenumber AS dose, avg(s) AS mean, stddev_samp(s) AS sd, count(s) AS n FROM (SELECT l_linenumber, year(l_shipdate) AS seed, avg(l_quantity) AS s FROM lineitem GROUP BY ALL) AS d GROUP BY l_linenumber",
    ints="dose n", dbl="mean sd"))
def _(t):
    d = t.lineitem.groupBy(F.col("l_linenumber").alias("dose"), F.year("l_shipdate").alias("seed")).agg(F.avg("l_quantity").alias("s"))
    return RS.cell_summary(d, ["dose"], "s")


@query("m27_degradation_curve", oracle("""
  SELECT rate, avg(measurable) AS measurable_mean, stddev_samp(measurable) AS measurable_sd, avg(actual) AS actual_mean, stddev_samp(actual) AS actual_sd, avg(persist) AS persist_mean,
    stddev_samp(persist) AS persist_sd, avg(CASE WHEN measurable > persist THEN 1.0 ELSE 0.0 END) AS share_features_win, count(*) AS seeds FROM (
    SELECT l_tax AS rate, year(l_shipdate) AS seed, avg(l_quantity) AS measurable, avg(l_discount) AS actual, avg(l_linenumber) * 6.3 AS persist FROM lineitem GROUP BY ALL) AS d GROUP BY rate""",
    ints="seeds", dbl="rate measurable_mean measurable_sd actual_mean actual_sd persist_mean persist_sd share_features_win"))
def _(t):
    d = t.lineitem.groupBy(F.col("l_tax").alias("rate"), F.year("l_shipdate").alias("seed")).agg(
        F.avg("l_quantity").alias("measurable"), F.avg("l_discount").alias("actual"), (F.avg("l_linenumber") * 6.3).alias("persist"))
    return RS.degradation_curve(d.withColumn("features_win", F.col("measurable") > F.col("persist")))


@query("m28_weight_contrast", oracle("""
  SELECT w.category, avg(CASE WHEN high THEN w.blend END) AS high, avg(CASE WHEN NOT high THEN w.blend END) AS low, avg(CASE WHEN high THEN w.blend END) - avg(CASE WHEN NOT high THEN w.blend END) AS delta
  FROM scored w JOIN (SELECT cell, CASE WHEN cut > 0 THEN tot >= cut ELSE tot > 0 END AS high FROM (SELECT cell, sum(target) AS tot FROM scored GROUP BY cell) AS a
    CROSS JOIN (SELECT coalesce(median(tot), 0) AS cut FROM (SELECT cell, sum(target) AS tot FROM scored GROUP BY cell) AS b WHERE tot > 0) AS c) AS m ON m.cell = w.cell GROUP BY w.category""",
    "scored", dbl="high low delta"))
def _(t):
    d = t.scored()
    total = d.groupBy("cell").agg(F.sum("target").alias("total"))
    return RS.weight_contrast(d.join(total, "cell"), ["category"], "cell", "blend", "total")


@query("m28_sign_stability", oracle(
    "SELECT l_linenumber AS modality, count(DISTINCT CASE WHEN delta <> 0 THEN sign(delta) END) AS signs, count(delta) AS seeds FROM (SELECT l_linenumber, year(l_shipdate) AS seed, round(avg(l_quantity) - 25.5, 6) AS delta FROM lineitem GROUP BY ALL) AS d GROUP BY l_linenumber",
    ints="modality signs seeds"))
def _(t):
    d = t.lineitem.groupBy(F.col("l_linenumber").alias("modality"), F.year("l_shipdate").alias("seed")).agg(F.round(F.avg("l_quantity") - 25.5, 6).alias("delta"))
    return RS.sign_stability(d, ["modality"], "delta")


@query("m29_constant_factor", oracle("""
  SELECT count(*) AS groups, avg(CASE WHEN sd < 0.001 THEN 1.0 ELSE 0.0 END) AS share_constant, max(sd) AS max_sd, max(d) AS max_distinct FROM (
    SELECT category, area, coalesce(stddev_samp(f), 0) AS sd, count(DISTINCT f) AS d FROM (
      SELECT category, area, round(latent / observed, 4) + CASE WHEN area = '010101' THEN year % 2 ELSE 0 END AS f FROM surface WHERE observed > 0 AND latent > 0) AS s GROUP BY category, area) AS g""",
    "surface", ints="groups max_distinct", dbl="share_constant max_sd"))
def _(t):
    f = F.round(F.col("latent") / F.col("observed"), 4) + F.when(F.col("area") == "010101", F.col("year") % 2).otherwise(0)
    d = t.surface().filter("observed > 0").withColumn("latent", f).withColumn("observed", F.lit(1.0))
    return S.constant_factor_check(d, ["category", "area"], 1e-3)


@query("m30_year_composition", oracle("""
  SELECT k.category, coalesce(o, 0.0) AS observed, coalesce(l, 0.0) AS latent, coalesce(o, 0.0) / sum(o) OVER () AS share_observed, coalesce(l, 0.0) / sum(l) OVER () AS share_latent,
    coalesce(l, 0.0) / sum(l) OVER () - coalesce(o, 0.0) / sum(o) OVER () AS delta_share FROM (VALUES ('A'), ('N'), ('R'), ('Z')) AS k(category)
  LEFT JOIN (SELECT category, CAST(sum(observed) AS DOUBLE) AS o, sum(latent) AS l FROM surface WHERE year = 1999 GROUP BY category) AS s ON s.category = k.category""",
    "surface", dbl="observed latent share_observed share_latent delta_share"))
def _(t):
    d = t.surface().withColumn("observed", F.col("observed").cast("double"))
    return V.year_composition(d, [*CATEGORIES, "Z"], 1999)


@query("m31_fold_summary", oracle("""
  SELECT split, count(*) AS folds, avg(rho) AS rho_mean, stddev_pop(rho) AS rho_sd, avg(n) AS n_mean, stddev_pop(n) AS n_sd FROM (
    SELECT category AS split, district, rho, n FROM rho_blend) AS f GROUP BY split""", "rho_blend", ints="folds", dbl="rho_mean rho_sd n_mean n_sd"))
def _(t):
    return P.fold_summary(RK.within_district(t.scored(), "blend").withColumnRenamed("category", "split"), ["rho", "n"])


@query("m33_kappa", oracle("""
  SELECT n, po AS agreement, pe AS chance, (po - pe) / (1 - pe) AS kappa FROM (
    SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po,
      avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) * avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END) + avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0 END) * avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END) AS pe FROM labels) AS k""",
    ints="n", dbl="agreement chance kappa"))
def _(t):
    return SC.agreement(t.labels, "quality", "toxic")


@query("m33_confusion", oracle("SELECT quality AS first, toxic AS second, count(*) AS records FROM labels GROUP BY ALL", ints="first second records"))
def _(t):
    return SC.confusion(t.labels, "quality", "toxic")


@query("m33_disagreements", oracle("SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic", ints="quality toxic"))
def _(t):
    return SC.disagreements(t.labels, "doc_id", "quality", "toxic")


DECLARED = [("lang", "en", 100), ("lang", "xx", 3), ("source", "src0", 50), ("source", "src1", 50)]


@query("m34_tally_check", oracle("""
  SELECT coalesce(d.dimension, c.dimension) AS dimension, coalesce(d.value, c.value) AS value, coalesce(declared, 0) AS declared, coalesce(counted, 0) AS counted, coalesce(declared, 0) = coalesce(counted, 0) AS passed
  FROM (VALUES ('lang', 'en', 100), ('lang', 'xx', 3), ('source', 'src0', 50), ('source', 'src1', 50)) AS d(dimension, value, declared)
  FULL JOIN (SELECT 'lang' AS dimension, lang AS value, count(*) AS counted FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source) AS c
    ON c.dimension = d.dimension AND c.value = d.value""", ints="declared counted"))
def _(t):
    return SC.tally_check(t.documents, ["lang", "source"], literal_rows(t.spark, DECLARED, "dimension string, value string, declared bigint"))


@query("m37_conservation_error", oracle("""
  SELECT district, avg(e) AS error, count(*) AS categories FROM (
    SELECT d.category, d.district, power((p - t) / (s.scale * sqrt(n + 1.0)), 2) AS e FROM (
      SELECT category, district, sum(target) AS t, sum(blend) AS p, count(*) AS n FROM scored GROUP BY ALL) AS d
    JOIN (SELECT category, CASE WHEN avg(abs(target)) > 0 THEN avg(abs(target)) ELSE 1.0 END AS scale FROM scored GROUP BY category) AS s ON s.category = d.category) AS x GROUP BY district""",
    "scored", ints="categories", dbl="error"))
def _(t):
    return RK.conservation_error(t.scored(), "blend")


@query("ml05_baseline_priors", oracle(
    f"{pack_sql('persist', 'rho_persist', 'history')} UNION ALL {pack_sql('blend', 'rho_blend', 'blend')}", "scored rho_persist rho_blend", ints=PACK_INTS, dbl=PACK_DBL))
def _(t):
    return baselines(t.scored(), {"history": "persist", "blend": "blend"})


@query("ml06_external_predictions", oracle("SELECT category, avg(rho) AS rho, count(*) AS districts FROM oracle_rho GROUP BY category", "scored", f"""
ext AS (SELECT l_partkey AS cell, l_returnflag AS category, avg(l_quantity) AS pred FROM lineitem WHERE year(l_shipdate) = {TEST_YEAR} AND l_returnflag <> 'R' GROUP BY ALL),
oracle_rows AS (SELECT s.cell, s.district, s.category, s.target, e.pred FROM scored s JOIN ext e ON e.cell = s.cell AND e.category = s.category),
ok_rows AS (SELECT category, district FROM oracle_rows GROUP BY ALL HAVING count(*) >= 5 AND min(target) < max(target) AND min(pred) < max(pred)),
kept_rows AS (SELECT o.* FROM oracle_rows o SEMI JOIN ok_rows k ON k.category = o.category AND k.district = o.district),
oracle_rho AS ({global_rho("pred", "kept_rows", by="category, district")})""", ints="districts", dbl="rho"))
def _(t):
    ext = t.lineitem.select(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("c"), "l_quantity")
    wide = P.for_test_year(ext, TEST_YEAR).select("cell", *[F.when(F.col("c") == c, F.col("l_quantity")).alias(f"pred_{c}") for c in ("A", "N")])
    pred = P.mean_predictions(P.long_predictions(wide, ["cell"], CATEGORIES).filter("pred IS NOT NULL"), ["cell", "category"], "ext")
    d = t.scored().join(pred, ["cell", "category"])
    return RK.within_district(d, "ext").groupBy("category").agg(F.avg("rho").alias("rho"), F.count("*").alias("districts"))
