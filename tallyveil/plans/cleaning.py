"""Scalar functions, filters and text cleaning over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.functions import codes as K
from tallyveil.functions import geo
from tallyveil.functions import text as X
from tallyveil.functions.vectors import cosine, dot, l2_normalise
from tallyveil.operators import bounds as B
from tallyveil.operators import corpus as C
from tallyveil.operators import models as M
from tallyveil.operators import panel as P
from tallyveil.operators import ranking as RK
from tallyveil.operators import screening as SC
from tallyveil.operators import surface as S
from tallyveil.operators import validation as V
from tallyveil.plans.catalog import TEST_YEAR, Tables, oracle, query
from tallyveil.session import literal_rows


@query("f01_zero_pad", oracle(
    "SELECT c_custkey, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS code, CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS short FROM (SELECT c_custkey, CAST(c_custkey * 7 AS VARCHAR) AS k FROM customer) AS s"))
def _(t):
    k = F.col("c_custkey") * 7
    return t.customer.select("c_custkey", K.zero_pad(k).alias("code"), K.zero_pad(k, 3).alias("short"))


@query("f02_compose_area", oracle("""
  SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || CASE WHEN c_custkey % 4 <> 0 THEN lpad(CAST(c_custkey % 25 AS VARCHAR), 2, '0') END
    || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS area FROM customer"""))
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", K.compose_area(F.col("c_nationkey"), F.when(k % 4 != 0, k % 25), k % 60).alias("area"))


RAW = """
  raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' || o_custkey || ' ' WHEN 2 THEN '-' || o_custkey WHEN 3 THEN o_custkey || 'x'
    WHEN 4 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') ELSE '0' END AS raw FROM orders)"""


def _raw(t: Tables):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    raw = (F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 2, F.concat(F.lit("-"), c)).when(k == 3, F.concat(c, F.lit("x")))
           .when(k == 4, F.replace(F.format_string("%s", F.col("o_totalprice")), F.lit("."), F.lit(","))).otherwise("0"))
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query("f03_strict_integer", oracle(
    "SELECT o_orderkey, CASE WHEN regexp_full_match(trim(raw), '[0-9]+') THEN CAST(trim(raw) AS BIGINT) END AS value FROM raw", "", RAW, ints="value"))
def _(t):
    return _raw(t).select("o_orderkey", K.strict_int("raw").alias("value"))


@query("f04_weight_or_drop", oracle(
    "SELECT * FROM (SELECT o_orderkey, try_cast(replace(raw, ',', '.') AS DOUBLE) AS weight FROM raw) AS w WHERE weight > 0", "", RAW, dbl="weight"))
def _(t):
    return _raw(t).select("o_orderkey", K.weight_or_null("raw").alias("weight")).filter("weight IS NOT NULL")


@query("f05_weight_or_zero", oracle(
    "SELECT o_orderkey, coalesce(try_cast(replace(raw, ',', '.') AS DOUBLE), 0) AS weight FROM raw", "", RAW, dbl="weight"))
def _(t):
    return _raw(t).select("o_orderkey", K.weight_or_zero("raw").alias("weight"))


@query("f06_accent_folding", oracle(
    "SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '^\\s+|\\s+$', '', 'g')) AS folded, strip_accents(lower(lang)) AS lang FROM documents"))
def _(t):
    return t.documents.select("doc_id", F.md5(K.fold_text("text").cast("binary")).alias("folded"), K.fold_text("lang").alias("lang"))


@query("f07_event_multiplicity", oracle("""
  SELECT l_orderkey, times, least(coalesce(CASE WHEN l_linenumber > 2 THEN l_linenumber END, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), times) AS sub FROM (
    SELECT *, CASE WHEN l_quantity * 1.2 BETWEEN 1 AND 50 THEN CAST(floor(l_quantity * 1.2) AS BIGINT) ELSE 1 END AS times FROM lineitem) AS k""",
    ints="times sub"))
def _(t):
    raw = F.floor(F.col("l_quantity") * 1.2)
    over = F.when(F.col("l_quantity") * 1.2 <= 50, raw).otherwise(99).cast("bigint")
    times = K.event_multiplicity(over)
    flag = (F.col("l_linestatus") == "F").cast("int")
    part = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("bigint"))
    return t.lineitem.select("l_orderkey", times.alias("times"), K.capped_subcount(part, times, flag).alias("sub"))


@query("f08_identifier_normalise", oracle("""
  SELECT page_id, trim(CASE WHEN starts_with(d, 'doi:') THEN substr(d, 5) ELSE d END) AS doi FROM (
    SELECT page_id, CASE WHEN starts_with(c, 'doi.org/') THEN substr(c, 9) ELSE c END AS d FROM (
      SELECT page_id, CASE WHEN starts_with(b, 'http://doi.org/') THEN substr(b, 16) ELSE b END AS c FROM (
        SELECT page_id, CASE WHEN starts_with(a, 'https://doi.org/') THEN substr(a, 17) ELSE a END AS b FROM (
          SELECT page_id, trim(lower(CASE page_id % 4 WHEN 0 THEN ' https://doi.org/' WHEN 1 THEN 'HTTP://doi.org/doi:' WHEN 2 THEN 'doi.org/' ELSE 'DOI: ' END || url)) AS a FROM pages) AS p) AS q) AS r) AS s"""))
def _(t):
    k = F.col("page_id") % 4
    raw = F.concat(F.when(k == 0, " https://doi.org/").when(k == 1, "HTTP://doi.org/doi:").when(k == 2, "doi.org/").otherwise("DOI: "), "url")
    return t.pages.select("page_id", K.normalise_doi(raw).alias("doi"))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens_sql(c: str, markup: bool) -> str:
    clean = f"regexp_replace(lower({c}), '<[^>]+>', ' ', 'g')"
    if markup:
        clean = f"regexp_replace({clean}, '&[a-z]+;|&#[0-9]+;', ' ', 'g')"
    clean = f"regexp_replace({clean}, '\\\\[a-z]+', ' ', 'g')"
    stop = X.STOP_WORDS + (X.MARKUP_WORDS if markup else [])
    test = f"NOT list_contains({_sql_list(stop)}, w)"
    if markup:
        test += " AND NOT (contains(w, '-') AND regexp_matches(w, 'formula|graphic|math|link|fig'))"
    return f"list_filter(regexp_extract_all({clean}, '[a-z][a-z\\-]{{2,}}'), lambda w: {test})"


@query("f09_tokenise", oracle(
    f"SELECT page_id, len(tok) AS n, md5(array_to_string(tok, ' ')) AS joined FROM (SELECT page_id, {tokens_sql('html', True)} AS tok FROM pages) AS p", ints="n"))
def _(t):
    d = t.pages.select("page_id", X.tokens(F.col("html")).alias("tok"))
    return d.select("page_id", F.size("tok").alias("n"), F.md5(F.array_join("tok", " ").cast("binary")).alias("joined"))


@query("f10_tokenise_plain", oracle(
    f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens_sql('text', False)}) AS term FROM documents) AS d GROUP BY term", ints="n"))
def _(t):
    return C.document_terms(t.documents, "doc_id", "text", markup=False).groupBy("term").agg(F.sum("tf").alias("n"))


GROUPS = [["than", "thor", "ition"], ["wher", "ingen", "erhe"], ["andsh", "ouen", "ential"]]


def groups_sql(c: str, groups) -> list[str]:
    return ["(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in g) + ")" for g in groups]


@query("f11_keyword_conjunction", oracle(f"SELECT doc_id, lang, {' AND '.join(groups_sql('text', GROUPS))} AS relevant FROM documents"))
def _(t):
    return t.documents.select("doc_id", "lang", X.all_groups(F.col("text"), GROUPS).alias("relevant"))


@query("f12_near_miss_screen", oracle(f"""
  SELECT source, count(*) AS screened, count(*) FILTER (WHERE g = 3) AS near_miss, count(*) FILTER (WHERE g = 2) AS partial, count(*) * 1.0 / sum(count(*)) OVER () AS share
  FROM (SELECT source, {' + '.join(f'CAST({g} AS INT)' for g in groups_sql('text', GROUPS))} AS g FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS d GROUP BY source""",
    ints="screened near_miss partial", dbl="share"))
def _(t):
    return SC.near_misses(t.documents, "text", GROUPS, t.labels, "doc_id", "source")


# Spaces, not word borders: engines differ in what a border next to an accented letter is.
OPENING, CLOSING = " (?:the|les|und|los) ", " (?:of|des|der|del) "
MARKED = f"""
marked AS (
  SELECT doc_id, regexp_matches(text, '(?i){OPENING}') AS hit, text, regexp_extract(text, '(?is)^(.*?){OPENING}', 1) AS pre, regexp_extract(text, '(?i){OPENING}', 0) AS m FROM documents),
beside AS (
  SELECT doc_id, hit, substr(text, length(pre) + 1) AS marked, substr(text, length(pre) + length(m) + 1) AS rest, regexp_extract(pre, '[^\n]*$', 0) AS before FROM marked),
below AS (
  SELECT *, list_transform(string_split(marked, chr(10))[2:], lambda l: trim(substr(l, length(before) - 6 + 1), ' ')) AS cut FROM beside),
cuts AS (SELECT *, list_position(list_transform(cut, lambda l: regexp_matches(l, '(?im){CLOSING}')), TRUE) AS last FROM below),
found AS (
  SELECT doc_id, trim(regexp_replace(CASE WHEN NOT hit THEN '' WHEN length(before) > 25 AND trim(before, ' ') <> ''
      THEN array_to_string(list_filter(CASE WHEN last > 0 THEN cut[:last - 1] ELSE cut END, lambda l: l <> ''), ' ')
    WHEN regexp_matches(rest, '(?im){CLOSING}') THEN regexp_extract(rest, '(?ims)^(.*?){CLOSING}', 1) ELSE rest END, '\\s+', ' ', 'g'), ' ') AS found FROM cuts)"""


@query("f13_marker_extraction", oracle("""
  SELECT doc_id, CASE WHEN length(found) >= 20 THEN found ELSE '' END AS found, CASE WHEN length(found) >= 20 THEN length(found) ELSE 0 END AS chars FROM found""", "", MARKED, ints="chars"))
def _(t):
    found = X.between_markers(F.col("text"), OPENING, CLOSING, min_chars=20)
    return t.documents.select("doc_id", found.alias("found")).withColumn("chars", F.length("found"))


@query("f14_coalesce_cascade", oracle("""
  SELECT doc_id, CASE WHEN a <> '' THEN 'bulk' WHEN b <> '' THEN 'batch' WHEN c <> '' THEN 'pdf' ELSE 'title_only' END AS body_source,
    length(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE '' END) AS chars FROM cascade""", "", """
  cascade AS (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN trim(text, ' ') ELSE '' END AS a, CASE WHEN toxic = 0 THEN lang ELSE '' END AS b, CASE WHEN quality = 1 THEN source ELSE '' END AS c
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""", ints="chars"))
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("a"), F.when(F.col("toxic") == 0, F.col("lang")).otherwise("  ").alias("b"),
        F.when(F.col("quality") == 1, F.col("source")).alias("c"))
    out = C.first_filled(d, [("a", "bulk"), ("b", "batch"), ("c", "pdf")], "body")
    return out.select("doc_id", "body_source", F.length("body").alias("chars"))


@query("f16_category_mapping", oracle("""
  SELECT o_orderkey, CASE strip_accents(lower(trim(label))) WHEN '1-urgent' THEN 'robo' WHEN '2-high' THEN 'robo' WHEN '5-low' THEN 'estafa' END AS category
  FROM (SELECT o_orderkey, ' ' || replace(o_orderpriority, 'I', 'Í') AS label FROM orders) AS s WHERE strip_accents(lower(trim(label))) IN ('1-urgent', '2-high', '5-low')"""))
def _(t):
    mapping = literal_rows(t.spark, [("1-urgent", "robo"), ("2-high", "robo"), ("5-low", "estafa")], "label string, category string")
    events = t.orders.select("o_orderkey", K.fold_text(F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit("I"), F.lit("Í")))).alias("label"))
    return events.join(mapping, "label").select("o_orderkey", "category")


@query("f17_canonical_rounding", oracle("""
  SELECT o_orderkey, round(v, 2)::DOUBLE AS half_up, round_even(v, 2)::DOUBLE AS half_even, (floor(v * 100) / 100)::DOUBLE AS down, CAST(CAST(round(v, 1) AS DECIMAL(18, 1)) AS VARCHAR) AS shown
  FROM (SELECT o_orderkey, CAST((o_custkey * 37 % 2001 - 1000) * 125 AS DECIMAL(18, 3)) / 1000 AS f, CAST(CAST((o_custkey * 37 % 2001 - 1000) * 125 AS DECIMAL(18,3)) * 0.001 AS DECIMAL(18, 3)) AS v FROM orders) AS k""",
    dbl="half_up half_even down"))
def _(t):
    v = ((F.col("o_custkey") * 37 % 2001 - 1000) * 125).cast("decimal(15,3)") * F.lit("0.001").cast("decimal(4,3)")
    d = t.orders.select("o_orderkey", v.cast("decimal(18,3)").alias("v"))
    return d.select("o_orderkey", K.canonical_round("v", 2, "half_up").alias("half_up"), K.canonical_round("v", 2, "half_even").alias("half_even"),
                    K.canonical_round("v", 2, "floor").alias("down"), K.canonical_display("v", 1).alias("shown"))


@query("f18_cited_numeral", oracle("""
  SELECT o_orderkey, try_cast(CASE WHEN contains(s, ',') AND contains(s, '.') THEN replace(s, ',', '') ELSE s END AS DECIMAL(28, 10))::DOUBLE AS cited FROM (
    SELECT o_orderkey, replace(regexp_replace(trim(raw), '^[×xX~]+', ''), ' ', '') AS s FROM (
      SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '× 4.6' WHEN 1 THEN '~1,2' || (o_custkey % 10) || '.5' WHEN 2 THEN 'x' || o_custkey WHEN 3 THEN '4,6' ELSE ' -0.' || o_custkey END AS raw FROM orders) AS a) AS b""",
    dbl="cited"))
def _(t):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    raw = (F.when(k == 0, "× 4.6").when(k == 1, F.concat(F.lit("~1,2"), (c % 10).cast("string"), F.lit(".5"))).when(k == 2, F.concat(F.lit("x"), c.cast("string")))
           .when(k == 3, "4,6").otherwise(F.concat(F.lit(" -0."), c.cast("string"))))
    return t.orders.select("o_orderkey", K.parse_cited(raw).alias("cited"))


@query("f19_rate_per_100k", oracle(
    "SELECT cell, category, CASE WHEN population > 0 THEN target / population * 1e5 END AS rate FROM scored", "scored", dbl="rate"))
def _(t):
    return t.scored().select("cell", "category", K.per_100k(F.col("target"), F.col("population")).alias("rate"))


@query("f20_log_target", oracle(
    "SELECT cell, category, ln(1 + target) AS y, exp(greatest(ln(1 + blend) - 0.5, 0)) - 1 AS back FROM scored", "scored", dbl="y back"))
def _(t):
    return t.scored().select("cell", "category", K.log_target("target").alias("y"), K.back_transform(F.log1p("blend") - 0.5).alias("back"))


@query("f21_unit_vectors", oracle("""
  SELECT vec_id AS id, sqrt(list_dot_product(u, u)) AS length, u[1] AS first, u[64] AS last FROM (
    SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) AS e) AS f""",
    dbl="length first last"))
def _(t):
    d = t.vectors().select("id", l2_normalise(F.col("vec")).alias("u"))
    return d.select("id", F.sqrt(dot(F.col("u"), F.col("u"))).alias("length"), F.col("u")[0].alias("first"), F.col("u")[63].alias("last"))


@query("f22_cosine", oracle("""
  SELECT a.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot,
    list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ((sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9)) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", dbl="dot cosine"))
def _(t):
    a = t.vectors().select("id", F.col("vec").alias("a"))
    b = t.vectors().select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return a.join(b, "id").select("id", dot(F.col("a"), F.col("b")).alias("dot"), cosine(F.col("a"), F.col("b")).alias("cosine"))


@query("f23_salton_index", oracle(
    "SELECT p_partkey, CASE WHEN p_size > 5 AND p_partkey % 7 > 0 THEN (p_partkey % 5) / (sqrt(p_size * (p_partkey % 7)) + 1e-9) ELSE 0 END AS salton FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS p_size FROM part) AS p", dbl="salton"))
def _(t):
    size = F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0)
    return t.part.select("p_partkey", K.salton(F.col("p_partkey") % 5, size, F.col("p_partkey") % 7).alias("salton"))


@query("f24_scaled_plane", oracle(
    "SELECT point, round((x - 50) / (max(abs(x - 50)) OVER () + 1e-9), 4) AS x, round((y - 50) / (max(abs(y - 50)) OVER () + 1e-9), 4) AS y FROM points", "points", dbl="x y"))
def _(t):
    return M.scale_plane(t.points().select("point", (F.col("x") - 50).alias("x"), (F.col("y") - 50).alias("y")))


@query("f25_point_to_cell", oracle("SELECT point, q, r, cell FROM hexed", "hexed"))
def _(t):
    return t.hexed().select("point", "q", "r", "cell")


@query("f26_fill_box", oracle("""
  SELECT q, r, CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell FROM (SELECT unnest(range((SELECT min(q) FROM cells_hex), (SELECT max(q) + 1 FROM cells_hex))) AS q) AS a
  CROSS JOIN (SELECT unnest(range((SELECT min(r) FROM cells_hex), (SELECT max(r) + 1 FROM cells_hex))) AS r) AS b""", "cells_hex"))
def _(t):
    return P.fill_box(t.cells_hex())


@query("f27_ring_neighbours", oracle("SELECT src, dst FROM ring", "ring"))
def _(t):
    return P.ring_edges(t.cells_hex())


@query("f28_nearest_facility", oracle(f"""
  SELECT cell, min(2 * {geo.EARTH_RADIUS_KM} * asin(least(1.0, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))) AS km
  FROM (SELECT c_custkey AS cell, -12.0 + x / 100 AS lat, -77.0 + y / 100 AS lon FROM customer JOIN points ON point = c_custkey) AS a
  CROSS JOIN (SELECT -12.0 + (s_suppkey * 7919 % 1009) / 1009.0 AS lat, -77.0 + (s_suppkey * 104729 % 997) / 997.0 AS lon FROM supplier) AS b GROUP BY cell""",
    "points", dbl="km", digits=5), digits=5)
def _(t):
    cells = t.points().select(F.col("point").alias("cell"), (F.lit(-12.0) + F.col("x") / 100).alias("lat"), (F.lit(-77.0) + F.col("y") / 100).alias("lon"))
    k = F.col("s_suppkey")
    sites = t.supplier.select((F.lit(-12.0) + (k * 7919 % 1009) / 1009.0).alias("lat"), (F.lit(-77.0) + (k * 104729 % 997) / 997.0).alias("lon"))
    return P.nearest_distance(cells, sites)


SEARCHES = {"broad": [["than the", "on the"], ["ition", "tion"]], "narrow": [["dark figure", "the th"], ["her", "ing"], ["nd"]]}


@query("f29_boolean_search", oracle(" UNION ALL ".join(
    f"SELECT '{n}' AS search, lang, count(*) AS hits FROM documents WHERE {' AND '.join(groups_sql('text', g))} GROUP BY lang" for n, g in SEARCHES.items()), ints="hits"))
def _(t):
    tests = F.array(*[F.struct(F.lit(n).alias("search"), X.all_groups(F.col("text"), g).alias("hit")) for n, g in SEARCHES.items()])
    return t.documents.select("lang", F.explode(tests).alias("s")).filter("s.hit").groupBy("s.search", "lang").agg(F.count("*").alias("hits"))


@query("f30_zero_fill", oracle("""
  SELECT p_partkey AS cell, coalesce(n, 0) AS poi_count_sold, coalesce(q, 0) AS poi_count_units, d AS other FROM part
  LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q, max(l_discount) AS d FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) AS l ON l_partkey = p_partkey""",
    ints="poi_count_sold", dbl="poi_count_units other"))
def _(t):
    found = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_partkey").alias("cell")).agg(
        F.count("*").alias("poi_count_sold"), F.sum("l_quantity").alias("poi_count_units"), F.max("l_discount").alias("other"))
    d = t.part.select(F.col("p_partkey").alias("cell")).join(found, "cell", "left")
    return d.fillna(0, [c for c in d.columns if c.startswith("poi_count_")])


# ---- filters ------------------------------------------------------------------------

@query("p01_prefix_scope", oracle("SELECT area, category, year, observed FROM observed WHERE starts_with(area, '01')", "observed", ints="year observed"))
def _(t):
    return t.observed().filter(F.col("area").startswith("01"))


@query("p02_year_scope", oracle(
    "SELECT area, category, sum(observed) AS observed FROM observed WHERE year BETWEEN 1995 AND 2000 AND year NOT IN (1996, 1997) GROUP BY area, category", "observed", ints="observed"))
def _(t):
    d = t.observed().filter(F.col("year").between(1995, 2000) & ~F.col("year").isin(1996, 1997))
    return d.groupBy("area", "category").agg(F.sum("observed").alias("observed"))


@query("p03_overlapping_scopes", oracle("""
  SELECT 'nacional' AS scope, count(*) AS records, sum(weight) AS weight FROM records UNION ALL
  SELECT 'lima', count(*), sum(weight) FROM records WHERE starts_with(area, '0101') OR starts_with(area, '0202')""", "records", ints="records", dbl="weight"))
def _(t):
    d = B.scope_rows(t.records(), F.col("area"), ["0101", "0202"], "lima")
    return d.groupBy("scope").agg(F.count("*").alias("records"), F.sum("weight").alias("weight"))


@query("p04_valid_responses", oracle(
    "SELECT l_linenumber AS answer, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4) GROUP BY l_linenumber", ints="answer n"))
def _(t):
    return t.lineitem.filter(F.col("l_linenumber").isin(1, 2, 3, 4)).groupBy(F.col("l_linenumber").alias("answer")).agg(F.count("*").alias("n"))


@query("p05_minimum_support", oracle("SELECT category, district FROM supported_persist", "supported_persist"))
def _(t):
    return RK.supported_groups(t.scored(), ["category", "district"], "persist", "target")


@query("p06_finite_pairs", oracle(
    "SELECT cell, category, target / population AS x, persist / population AS y FROM scored WHERE population > 0 AND target > 0", "scored", dbl="x y"))
def _(t):
    x = F.when(F.col("target") > 0, F.try_divide("target", "population"))
    y = F.when(F.col("population") > 0, F.col("persist") / F.col("population")).otherwise(F.lit(float("nan")))
    return t.scored().select("cell", "category", x.alias("x"), y.alias("y")).filter(K.finite_pair(F.col("x"), F.col("y")))


@query("p07_exclusion_reasons", oracle("""
  SELECT category, reason, count(*) AS areas, sum(observed) AS observed FROM (
    SELECT o.category, o.observed, CASE WHEN r.area IS NULL THEN 'no rate' WHEN r.category = 'R' THEN 'rate not usable' END AS reason
    FROM observed o LEFT JOIN (SELECT * FROM rate_rows WHERE NOT starts_with(area, '03')) AS r ON r.area = o.area AND r.category = o.category) AS j
  WHERE reason IS NOT NULL GROUP BY category, reason""", "observed rate_rows", ints="areas observed"))
def _(t):
    rates = t.rate_rows().filter(~F.col("area").startswith("03")).withColumn("r_hat", F.when(F.col("category") == "R", 0.0).otherwise(F.col("r_hat")))
    d = S.exclusion_reason(S.attach_rates(t.observed(), rates, t.population())).filter("reason IS NOT NULL")
    return d.groupBy("category", "reason").agg(F.count("*").alias("areas"), F.sum("observed").alias("observed"))


@query("p08_test_year_predictions", oracle(
    f"SELECT cell, year, category, count AS pred FROM counts WHERE year = {TEST_YEAR}", "counts", ints="year", dbl="pred"))
def _(t):
    d = t.counts().withColumnRenamed("count", "pred").withColumn("year", F.when(F.col("cell") % 2 == 0, F.col("year")).otherwise(F.when(F.col("year") != TEST_YEAR, F.col("year"))))
    return P.for_test_year(d, TEST_YEAR).withColumn("year", F.lit(TEST_YEAR)).select("cell", "year", "category", "pred")


@query("p09_known_district", oracle("""
  SELECT cell, CASE WHEN cell % 3 = 0 THEN '0401XX' ELSE district END AS district, population FROM units WHERE cell % 3 <> 0 OR population > 0""",
    "units", dbl="population"))
def _(t):
    d = t.units().withColumn("district", F.when(F.col("cell") % 3 != 0, F.col("district")))
    return P.with_known_district(d, "0401XX").select("cell", "district", "population")


@query("p10_completeness_gate", oracle(
    "SELECT area FROM areas WHERE area NOT IN (SELECT area FROM population WHERE population > 60000)", "areas population"))
def _(t):
    return V.require_denominator(t.areas(), t.population().filter("population > 60000").select("area").distinct())


@query("p11_skip_empty_categories", oracle(
    "SELECT district, category, sum(target) AS target FROM scored GROUP BY ALL HAVING sum(target) > 0", "scored", dbl="target"))
def _(t):
    return t.scored().groupBy("district", "category").agg(F.sum("target").alias("target")).filter("target > 0")


