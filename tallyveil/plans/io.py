"""Sources, sinks and reshaping over the shared tables.

Text and archive inputs are first derived from the tables by Spark, then read back
through the readers under test.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tallyveil.operators import corpus as C
from tallyveil.operators import panel as P
from tallyveil.plans.catalog import CATEGORIES, TEST_YEAR, Tables, oracle, query
from tallyveil.session import scratch_path
from tallyveil.sources import readers as RD
from tallyveil.sources import writers as WR


def _archives(t: Tables):
    """Line items packed by the tasks into nested archives, one per batch of rows."""
    def pack(batches):
        for pdf in batches:
            lines = ["l_orderkey;l_linenumber;l_quantity;l_returnflag"]
            lines += [f"{a};{b};{str(c).replace('.', ',')};{d}" for a, b, c, d in pdf.itertuples(index=False)]
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("WAVE_CAP_600.csv", "\n".join(lines).encode("latin-1"))
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("inner.zip", inner.getvalue())
            yield pd.DataFrame({"path": [f"wave-{lines[1] if len(lines) > 1 else ''}.zip"], "content": [outer.getvalue()]})

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rows.mapInPandas(pack, "path string, content binary")


@query("io01_survey_archive", oracle(
    "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS weight FROM lineitem GROUP BY l_returnflag", ints="n", dbl="weight"))
def _(t):
    from tallyveil.functions.codes import weight_or_null

    rows = RD.survey_columns(_archives(t), ["L_RETURNFLAG", "l_quantity"])
    d = rows.select(F.col("L_RETURNFLAG").alias("flag"), weight_or_null("l_quantity").alias("w"))
    return d.groupBy("flag").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


@query("io02_drop_short_rows", oracle(
    "SELECT l_returnflag AS flag, count(*) AS n, sum(CAST(q AS DOUBLE)) AS q FROM (SELECT l_returnflag, CAST(l_quantity AS VARCHAR) AS q FROM lineitem WHERE l_linenumber <> 7) AS k GROUP BY l_returnflag",
    ints="n", dbl="q"))
def _(t):
    full = F.concat_ws(";", F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), "l_returnflag")
    short = F.col("l_orderkey").cast("string")
    lines = t.lineitem.select(F.when(F.col("l_linenumber") == 7, short).otherwise(full).alias("text"))
    rows = RD.split_rows(lines, ["order", "quantity", "flag"])
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("double")).alias("q"))


def _csv(t: Tables, df, sep: str, label: str) -> str:
    path = scratch_path(t.spark, label)
    df.write.csv(path, sep=sep, header=True, encoding="ISO-8859-1" if sep == ";" else "UTF-8")
    return path


@query("io03_simple_survey_scan", oracle(
    "SELECT c_custkey AS id, c_mktsegment AS segment, replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS balance FROM customer", ints="id"))
def _(t):
    d = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"),
                          F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("balance"))
    back = RD.read_simple_survey(t.spark, _csv(t, d, ";", "survey"))
    return back.select(F.col("id").cast("bigint").alias("id"), "segment", "balance")


@query("io04_registry_scan", oracle(
    "SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS area, c_mktsegment AS label, count(*) AS count FROM customer GROUP BY ALL", ints="count"))
def _(t):
    from tallyveil.functions.codes import zero_pad

    d = t.customer.groupBy(zero_pad("c_nationkey").alias("area"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("count"))
    return RD.read_registry(t.spark, _csv(t, d, ",", "registry"), "area string, label string, count bigint")


@query("io05_tab_scan", oracle("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents"))
def _(t):
    return RD.read_tsv(t.spark, _csv(t, t.documents.select("doc_id", "lang", "source"), "\t", "tsv"))


@query("io06_typed_scan", oracle(
    "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS balance FROM customer",
    ints="nation", dbl="balance"))
def _(t):
    d = t.customer.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"),
        F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("string")).alias("balance"))
    return RD.read_typed_csv(t.spark, _csv(t, d, ",", "typed"), {"nation": "bigint", "balance": "double"})


@query("io07_pruned_scan", oracle("SELECT p_partkey, p_size, p_retailprice FROM part", ints="p_size", dbl="p_retailprice"))
def _(t):
    return RD.read_columns(t.spark, t.path("part"), ["p_partkey"], ["p_size", "poi_count_bank", "p_retailprice"])


@query("io08_predicate_scan", oracle(
    "SELECT l_orderkey, l_quantity, l_shipdate::VARCHAR AS shipped FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber IN (1, 2, 3) AND l_returnflag NOT IN ('A')",
    dbl="l_quantity"))
def _(t):
    d = RD.scan(t.spark, t.path("lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"], {"l_linestatus": "F"},
                {"l_linenumber": [1, 2, 3]}, {"l_returnflag": ["A"]})
    return d.select("l_orderkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


def _corpus_json(t: Tables):
    """One nested corpus document per text: its lines are the papers."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")).alias("paperId"), x.alias("title"),
        F.when(i % 2 == 0, F.length(x).cast("bigint")).alias("citationCount"),
        F.when(i % 3 == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("https://doi.org/10.1/"), F.col("doc_id").cast("string")))).alias("externalIds"),
        F.when(i % 4 == 0, F.struct(F.lit("short").alias("text"))).alias("tldr"),
        F.when(i % 5 == 0, F.array(F.col("source"), F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("fieldsOfStudy"),
    ))
    path = scratch_path(t.spark, "corpus")
    t.documents.select(F.to_json(F.struct(F.struct(F.col("lang").alias("query")).alias("meta"), lines.alias("papers"))).alias("value")).write.text(path)
    return path


LINES = """
  lines AS (SELECT doc_id, lang, source, i - 1 AS i, parts[i] AS title FROM (
    SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) AS a) AS b)"""


@query("io09_nested_corpus", oracle(
    "SELECT doc_id || '-' || i AS paper, lang AS query, length(title) AS title_chars FROM lines", "", LINES, ints="title_chars"))
def _(t):
    papers = RD.read_corpus(t.spark, _corpus_json(t), multi_line=False)
    return papers.select(F.col("paperId").alias("paper"), "query", F.coalesce(F.length("title"), F.lit(0)).alias("title_chars"))


@query("f15_nested_defaults", oracle("""
  SELECT doc_id || '-' || i AS paper, CASE WHEN i % 3 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi, CASE WHEN i % 4 = 0 THEN 'short' ELSE '' END AS tldr,
    CASE WHEN i % 5 = 0 THEN source END AS field, CASE WHEN i % 2 = 0 THEN length(title) ELSE 0 END AS citations FROM lines""",
    "", LINES, ints="citations"))
def _(t):
    flat = RD.flatten_papers(RD.read_corpus(t.spark, _corpus_json(t), multi_line=False))
    return flat.select("paper", "doi", "tldr", "field", "citations")


@query("io10_front_matter", oracle("""
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'stub' || doc_id ELSE 'k' || doc_id END AS key, CASE WHEN doc_id % 2 = 0 THEN '10.1/ab' || doc_id ELSE '' END AS doi,
    CASE WHEN doc_id % 4 = 0 THEN 'accepted' ELSE '' END AS screening FROM documents WHERE doc_id % 5 <> 0"""))
def _(t):
    i = F.col("doc_id")
    s = i.cast("string")
    head = F.concat(
        F.when(i % 5 != 0, "---\n").otherwise(""), F.when(i % 3 != 0, F.concat(F.lit('key: "k'), s, F.lit('"\n'))).otherwise(""),
        F.when(i % 2 == 0, F.concat(F.lit("doi: https://doi.org/10.1/AB"), s, F.lit("\n"))).otherwise(""),
        F.when(i % 4 == 0, "screening: accepted\n").otherwise(""), F.lit("---\n"))
    texts = t.documents.select(F.concat(F.lit("/papers/stub"), s, F.lit(".md")).alias("path"), F.concat(head, F.regexp_replace("text", "---", "")).alias("text"))
    return RD.front_matter(texts)


@query("io11_incremental_load", oracle("""
  SELECT o_orderkey AS key, 'cached' AS origin FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""))
def _(t):
    cache = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.lit("cached").alias("origin"))
    wanted = t.lineitem.select(F.col("l_orderkey").alias("key")).distinct().withColumn("origin", F.lit("new"))
    return C.extend_with_missing(cache, wanted, "key")


@query("io12_csv_sink", oracle("SELECT category, area, year, observed FROM observed", "observed", ints="year observed"))
def _(t):
    path = WR.write_csv(t.observed().select("category", "area", "year", "observed"), scratch_path(t.spark, "out-csv"))
    return RD.read_registry(t.spark, path, "category string, area string, year int, observed bigint")


@query("io13_parquet_sink", oracle("SELECT area, category, year, latent FROM surface", "surface", ints="year", dbl="latent"))
def _(t):
    path = WR.write_surface(t.surface().select("area", "category", "year", "latent"), scratch_path(t.spark, "out-surface"))
    return t.spark.read.parquet(path).select("area", "category", "year", "latent")


@query("io14_json_sink", oracle("SELECT area, category, year, observed FROM observed", "observed", ints="year observed"))
def _(t):
    path = WR.write_json(t.observed().select("area", "category", "year", "observed"), ["area", "category"], scratch_path(t.spark, "out-json"))
    back = t.spark.read.json(path, schema="area string, category string, values struct<year: int, observed: bigint>")
    return back.select("area", "category", "values.year", "values.observed")


@query("io15_wide_to_long", oracle(
    "SELECT l_partkey AS cell, l_returnflag AS category, CAST(count(*) AS DOUBLE) AS pred FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL", dbl="pred"))
def _(t):
    wide = P.wide_targets(t.counts().filter("category <> 'N'"), ["cell"], CATEGORIES, "count")
    wide = wide.select("cell", *[F.col(c).alias(f"pred_{c}") for c in ("A", "R")])
    return P.long_predictions(wide, ["cell"], CATEGORIES).filter("pred IS NOT NULL")


@query("io16_long_to_wide", oracle("""
  SELECT cell, year, sum(CASE WHEN category = 'A' THEN count END) AS "A", sum(CASE WHEN category = 'N' THEN count END) AS "N",
    sum(CASE WHEN category = 'R' THEN count END) AS "R" FROM counts GROUP BY cell, year""", "counts", ints="year", dbl="A N R"))
def _(t):
    return P.wide_targets(t.counts(), ["cell", "year"], CATEGORIES, "count")


@query("io17_replace_targets", oracle(f"""
  SELECT s.cell, s.category, s.persist, c.count AS target FROM scored s LEFT JOIN (SELECT * FROM counts WHERE year = {TEST_YEAR + 1}) AS c
    ON c.cell = s.cell AND c.category = s.category""", "scored counts", dbl="persist target"))
def _(t):
    other = t.counts().filter(F.col("year") == TEST_YEAR + 1).withColumnRenamed("count", "target")
    return P.replace_targets(t.scored(), other, ["cell", "category"], ["target"]).select("cell", "category", "persist", "target")
