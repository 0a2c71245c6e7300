"""Query registry and the table roles the queries are written against.

The shared tables stand in for the logical inputs: line items are survey records,
orders are registered events, parts are grid cells, documents are papers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions import codes
from tallyveil.operators import panel as P
from tallyveil.operators import rates as R
from tallyveil.operators import surface as S
from tallyveil.session import literal_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEARS = list(range(1995, 2002))
CATEGORIES = ["A", "N", "R"]
TEST_YEAR = 2000
PRIOR_MU, PRIOR_PHI = 0.5, 40.0


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, doubles rounded, so that engines can be compared value by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracle(final: str, roles: str = "", steps: str = "", ints: str = "", dbl: str = "", digits: int = 6) -> str:
    """SQL text: shared role CTEs, own steps, then the final select with uniform types."""
    ctes, done = [], set()

    def add(role: str) -> None:
        if role in done:
            return
        done.add(role)
        needs, body = ROLE_SQL[role]
        for n in needs.split():
            add(n)
        ctes.append(f"{role} AS ({body})")

    for role in roles.split():
        add(role)
    if steps:
        ctes.append(steps.strip().rstrip(","))
    replaced = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    replaced += [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in dbl.split()]
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    picked = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
    return f"{head}SELECT {picked} FROM ({final}) AS final_rows"


# ---- SQL of the roles ---------------------------------------------------------------

AREA = "lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '01'"

ROLE_SQL: dict[str, tuple[str, str]] = {
    "areas": ("", f"SELECT n_nationkey AS area_key, {AREA} AS area FROM nation"),
    "records": ("areas", """
        SELECT l_orderkey AS person, year(l_shipdate) AS year, l_returnflag AS category,
          CASE WHEN l_tax > 0 THEN area END AS area, l_quantity AS weight, CAST(l_linenumber AS BIGINT) AS times,
          CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS pnp,
          least(CAST(l_linenumber AS BIGINT) % 4, CAST(l_linenumber AS BIGINT)) AS pnp_count,
          CASE WHEN l_linestatus = 'F' OR l_discount >= 0.05 THEN 1 ELSE 0 END AS any_count
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN areas ON s_nationkey = area_key"""),
    "cells_raw": ("records", """
        SELECT year, category, CASE WHEN grouping(area) = 1 THEN '_NAC' ELSE area END AS area, grouping(area) AS lvl,
          sum(weight) AS sw, sum(weight * weight) AS sw2, sum(weight * pnp) AS swd, sum(weight * times) AS w_times,
          sum(weight * times * weight * times) AS w_times2, sum(weight * pnp_count) AS w_pnp,
          sum(weight * any_count) AS w_any, count(*) AS n
        FROM records GROUP BY GROUPING SETS ((year, category, area), (year, category))"""),
    "cells": ("cells_raw", "SELECT * EXCLUDE (lvl) FROM cells_raw WHERE lvl = 1 OR area IS NOT NULL"),
    "pooled": ("cells", """
        SELECT *, sw * sw / sw2 AS n_eff, swd / sw AS p, swd / sw * (sw * sw / sw2) AS y_eff FROM (
          SELECT category, area, sum(sw) AS sw, sum(sw2) AS sw2, sum(swd) AS swd, sum(w_times) AS w_times,
            sum(w_times2) AS w_times2, sum(w_pnp) AS w_pnp, sum(w_any) AS w_any, sum(n) AS n
          FROM cells WHERE area <> '_NAC' GROUP BY category, area) AS s"""),
    "rated": ("pooled", f"""
        SELECT f.category, f.area, coalesce(n_eff, 0.0) AS n_eff, coalesce(y_eff, 0.0) AS y_eff,
          {PRIOR_MU * PRIOR_PHI} + coalesce(y_eff, 0.0) AS alpha,
          {(1 - PRIOR_MU) * PRIOR_PHI} + greatest(coalesce(n_eff, 0.0) - coalesce(y_eff, 0.0), 0.0) AS beta
        FROM (SELECT area, category FROM areas CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS c(category)) AS f
        LEFT JOIN pooled USING (category, area)"""),
    "observed": ("areas", """
        SELECT area, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' WHEN 'P' THEN 'R' END AS category,
          year(o_orderdate) AS year, count(*) AS observed
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN areas ON c_nationkey = area_key GROUP BY ALL"""),
    "population": ("areas", """
        SELECT area, y.year AS year, n * 1000 + (y.year - 1995) * 10 AS population
        FROM (SELECT area, count(*) AS n FROM customer JOIN areas ON c_nationkey = area_key GROUP BY area) AS c
        CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) AS y"""),
    # Fixed band around the posterior mean; the exact Beta interval is tested on its own.
    "rate_rows": ("rated", """
        SELECT category, area, n_eff, alpha, beta, alpha / (alpha + beta) AS r_hat,
          greatest(0.0, alpha / (alpha + beta) - 1.96 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))) AS r_low,
          alpha / (alpha + beta) + 1.96 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS r_high
        FROM rated"""),
    "surface": ("observed rate_rows population", """
        SELECT o.area, o.category, o.year, o.observed, r.r_hat, r.r_low, r.r_high, r.alpha, r.beta, p.population,
          o.observed / r.r_hat AS latent, CASE WHEN r.r_high > 0 THEN o.observed / r.r_high END AS latent_low,
          CASE WHEN r.r_low > 0 THEN o.observed / r.r_low END AS latent_high, 1.0 / r.r_hat AS factor,
          CASE WHEN p.population > 0 THEN o.observed / r.r_hat / p.population * 1e5 END AS latent_per_100k,
          CASE WHEN r.r_hat < 0.05 THEN 1 ELSE 0 END AS unstable
        FROM observed o JOIN rate_rows r USING (area, category) LEFT JOIN population p ON p.area = o.area AND p.year = o.year
        WHERE r.r_hat > 0"""),
    "units": ("", """
        SELECT p_partkey AS cell, lpad(CAST(p_size AS VARCHAR), 6, '0') AS district,
          CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE floor(p_retailprice) END AS population, p_retailprice AS price FROM part"""),
    "counts": ("", """
        SELECT l_partkey AS cell, year(l_shipdate) AS year, l_returnflag AS category, CAST(count(*) AS DOUBLE) AS count
        FROM lineitem GROUP BY ALL"""),
    "panel": ("units counts", """
        SELECT u.*, y.year AS year, k.category AS category, coalesce(c.count, 0.0) AS target, coalesce(l1.count, 0.0) AS persist,
          coalesce(l2.count, 0.0) AS lag2, round(0.6 * coalesce(l1.count, 0.0) + 0.3 * coalesce(l2.count, 0.0) + price / 100000.0, 6) AS blend
        FROM units u CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) AS y CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS k(category)
        LEFT JOIN counts c ON c.cell = u.cell AND c.year = y.year AND c.category = k.category
        LEFT JOIN counts l1 ON l1.cell = u.cell AND l1.year + 1 = y.year AND l1.category = k.category
        LEFT JOIN counts l2 ON l2.cell = u.cell AND l2.year + 2 = y.year AND l2.category = k.category"""),
    "scored": ("panel", f"SELECT * FROM panel WHERE year = {TEST_YEAR}"),
    "supported_persist": ("scored", """
        SELECT category, district FROM scored GROUP BY ALL
        HAVING count(*) >= 5 AND count(DISTINCT target) >= 2 AND count(DISTINCT persist) >= 2"""),
    "supported_blend": ("scored", """
        SELECT category, district FROM scored GROUP BY ALL
        HAVING count(*) >= 5 AND count(DISTINCT target) >= 2 AND count(DISTINCT blend) >= 2"""),
    "rho_persist": ("supported_persist", """
        SELECT category, district, corr(rx, ry) AS rho, count(*) AS n FROM (
          SELECT category, district, rank() OVER (PARTITION BY category, district ORDER BY persist)
              + (count(*) OVER (PARTITION BY category, district, persist) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY category, district ORDER BY target)
              + (count(*) OVER (PARTITION BY category, district, target) - 1) / 2.0 AS ry
          FROM scored SEMI JOIN supported_persist USING (category, district)) AS r GROUP BY category, district"""),
    "rho_blend": ("supported_blend", """
        SELECT category, district, corr(rx, ry) AS rho, count(*) AS n FROM (
          SELECT category, district, rank() OVER (PARTITION BY category, district ORDER BY blend)
              + (count(*) OVER (PARTITION BY category, district, blend) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY category, district ORDER BY target)
              + (count(*) OVER (PARTITION BY category, district, target) - 1) / 2.0 AS ry
          FROM scored SEMI JOIN supported_blend USING (category, district)) AS r GROUP BY category, district"""),
    "points": ("", """
        SELECT c_custkey AS point, CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 100.0 AS x,
          CAST((c_custkey * 104729) % 10009 AS DOUBLE) / 100.0 AS y, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS value
        FROM customer"""),
    "hexed": ("points", """
        SELECT * EXCLUDE (fq, fr, fs, rq, rr, rs, q, r), q::BIGINT AS q, r::BIGINT AS r, CAST(q::BIGINT AS VARCHAR) || ':' || CAST(r::BIGINT AS VARCHAR) AS cell FROM (
          SELECT *, CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs) THEN -rr - rs ELSE rq END AS q,
            CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs) THEN rr
              WHEN abs(rr - fr) > abs(rs - fs) THEN -rq - rs ELSE rr END AS r FROM (
            SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(fs + 0.5) AS rs FROM (
              SELECT *, -fq - fr AS fs FROM (
                SELECT *, (1.7320508075688772 / 3.0 * x - 1.0 / 3.0 * y) / 4.0 AS fq, (2.0 / 3.0 * y) / 4.0 AS fr
                FROM points WHERE x BETWEEN 1 AND 99 AND y BETWEEN 1 AND 99) AS a) AS b) AS c) AS d"""),
    "cells_hex": ("hexed", "SELECT DISTINCT cell, q, r FROM hexed"),
    "ring": ("cells_hex", """
        SELECT s.cell AS src, d.cell AS dst FROM cells_hex s
        CROSS JOIN (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AS o(dq, dr)
        JOIN cells_hex d ON d.q = s.q + dq AND d.r = s.r + dr"""),
    "papers": ("", """
        SELECT s_suppkey AS paper, count(l_partkey) AS citations, CAST(sum(l_linenumber) AS BIGINT) AS influential,
          s_acctbal < 1000 AS selected, 'c' || CAST(s_nationkey % 5 AS VARCHAR) AS cluster
        FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey, s_acctbal"""),
    "refs": ("", "SELECT DISTINCT l_suppkey AS paper, l_partkey AS other FROM lineitem"),
    "citers": ("", "SELECT DISTINCT l_suppkey AS paper, l_orderkey AS other FROM lineitem"),
    "core": ("papers refs citers", """
        SELECT paper FROM papers WHERE selected UNION ALL SELECT paper FROM (
          SELECT other AS paper FROM (
            SELECT other FROM refs WHERE paper IN (SELECT paper FROM papers WHERE selected) UNION ALL SELECT other FROM citers WHERE paper IN (SELECT paper FROM papers WHERE selected)) AS s
          WHERE other NOT IN (SELECT paper FROM papers WHERE selected) GROUP BY other HAVING count(*) >= 2
          QUALIFY row_number() OVER (ORDER BY count(*) DESC, other) <= 90 - (SELECT count(*) FROM papers WHERE selected)) AS grown"""),
}


class Tables:
    """Shared tables and the roles derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def areas(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").alias("area_key"),
            codes.compose_area(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.lit(1)).alias("area"),
        )

    def records(self) -> DataFrame:
        times = F.col("l_linenumber").cast("bigint")
        pnp = (F.col("l_linestatus") == "F").cast("int")
        # Suppliers are joined by themselves: the planner knows their size and need not shuffle the line items while they are few.
        place = self.supplier.select("s_suppkey", "s_nationkey")
        placed = self.lineitem.join(place, F.col("l_suppkey") == F.col("s_suppkey")).join(self.areas(), F.col("s_nationkey") == F.col("area_key"))
        return placed.select(
            F.col("l_orderkey").alias("person"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("category"),
            F.when(F.col("l_tax") > 0, F.col("area")).alias("area"), F.col("l_quantity").alias("weight"),
            codes.event_multiplicity(times).alias("times"), pnp.alias("pnp"),
            codes.capped_subcount(times % 4, codes.event_multiplicity(times), pnp).alias("pnp_count"),
            ((F.col("l_linestatus") == "F") | (F.col("l_discount") >= 0.05)).cast("int").alias("any_count"),
        )

    def cells(self) -> DataFrame:
        return R.weighted_cells(self.records())

    def pooled(self, unit: str = "victim") -> DataFrame:
        return R.effective(R.pool_cells(self.cells().filter(F.col("area") != R.ALL_AREAS), ["category", "area"]), unit)

    def category_list(self) -> DataFrame:
        return literal_rows(self.spark, [(c,) for c in CATEGORIES], "category string")

    def rated(self) -> DataFrame:
        """Posterior rates under a fixed prior, one row per listed area and category."""
        frame = R.on_area_list(self.pooled(), self.areas(), CATEGORIES)
        prior = self.category_list().withColumns({"mu": F.lit(PRIOR_MU), "phi": F.lit(PRIOR_PHI)})
        return R.posterior(frame, prior)

    def rate_rows(self) -> DataFrame:
        a, b = F.col("alpha"), F.col("beta")
        half = 1.96 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        return self.rated().select(
            "category", "area", "n_eff", "alpha", "beta", "r_hat",
            F.greatest(F.lit(0.0), F.col("r_hat") - half).alias("r_low"), (F.col("r_hat") + half).alias("r_high"),
        )

    def status_map(self) -> DataFrame:
        return literal_rows(self.spark, [("F", "A"), ("O", "N"), ("P", "R")], "o_orderstatus string, category string")

    def observed(self) -> DataFrame:
        place = self.customer.join(self.areas(), F.col("c_nationkey") == F.col("area_key")).select("c_custkey", "area")
        events = self.orders.join(place, F.col("o_custkey") == F.col("c_custkey")).groupBy(
            "area", "o_orderstatus", F.year("o_orderdate").alias("year")
        ).agg(F.count("*").alias("count"))
        return S.observed_counts(events, self.status_map(), "o_orderstatus")

    def population(self) -> DataFrame:
        n = self.customer.join(self.areas(), F.col("c_nationkey") == F.col("area_key")).groupBy("area").agg(F.count("*").alias("n"))
        years = n.withColumn("year", F.explode(F.array(*[F.lit(y) for y in YEARS])))
        return years.select("area", "year", (F.col("n") * 1000 + (F.col("year") - 1995) * 10).alias("population"))

    def surface(self) -> DataFrame:
        return S.invert(S.attach_rates(self.observed(), self.rate_rows(), self.population()))

    def units(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("cell"), codes.zero_pad("p_size").alias("district"),
            F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.floor("p_retailprice").cast("double")).alias("population"),
            F.col("p_retailprice").alias("price"),
        )

    def counts(self) -> DataFrame:
        return self.lineitem.groupBy(
            F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("category")
        ).agg(F.count("*").cast("double").alias("count"))

    def panel(self, years: Sequence[int] = YEARS) -> DataFrame:
        points = self.lineitem.select(
            F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("category"), F.lit(1.0).alias("count")
        )
        d = P.dense_lags(self.units(), points, years, CATEGORIES, "count", {"target": 0, "persist": 1, "lag2": 2})
        blend = 0.6 * F.col("persist") + 0.3 * F.col("lag2") + F.col("price") / 100000.0
        return d.withColumn("blend", F.round(blend, 6))

    def scored(self) -> DataFrame:
        return self.panel([TEST_YEAR])

    def points(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("point"),
            (((F.col("c_custkey") * 7919) % 10007).cast("double") / 100.0).alias("x"),
            (((F.col("c_custkey") * 104729) % 10009).cast("double") / 100.0).alias("y"),
            F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"),
        )

    def hexed(self) -> DataFrame:
        return P.points_to_cells(self.points(), "x", "y", (1.0, 1.0, 99.0, 99.0), 4.0)

    def cells_hex(self) -> DataFrame:
        return self.hexed().select("cell", "q", "r").distinct()

    def papers(self) -> DataFrame:
        cited = self.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("citations"), F.sum("l_linenumber").alias("influential"))
        return self.supplier.join(cited, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
            F.col("s_suppkey").alias("paper"), F.coalesce("citations", F.lit(0)).alias("citations"), "influential",
            (F.col("s_acctbal") < 1000).alias("selected"),
            F.concat(F.lit("c"), (F.col("s_nationkey") % 5).cast("string")).alias("cluster"),
        )

    def refs(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("paper"), F.col("l_partkey").alias("other")).distinct()

    def citers(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("paper"), F.col("l_orderkey").alias("other")).distinct()

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
