"""Registry of published figures and the streaming cells over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.operators import registry as RG
from tallyveil.plans.catalog import Tables, oracle, query
from tallyveil.session import literal_rows
from tallyveil.sources.readers import number_lines
from tallyveil.streaming import cells as ST

POLICY = [("1-URGENT", "F", 2, "half_up"), ("2-HIGH", "O", 1, "half_even"), ("3-MEDIUM", "F", 0, "floor"), ("4-NOT SPECIFIED", "P", 2, "half_up")]
POLICY_SQL = "policy AS (SELECT * FROM (VALUES ('1-URGENT', 'F', 2, 'half_up'), ('2-HIGH', 'O', 1, 'half_even'), ('3-MEDIUM', 'F', 0, 'floor'), ('4-NOT SPECIFIED', 'P', 2, 'half_up')) AS p(family, canonical_variant, decimals, round_mode))"


def _policy(t: Tables):
    return literal_rows(t.spark, POLICY, "family string, canonical_variant string, decimals int, round_mode string")


FIGURES = POLICY_SQL + """,
figures AS (SELECT o_orderpriority AS family, o_orderstatus AS variant, round(sum(CAST(o_totalprice * 100 AS BIGINT)) / 100.0 / count(*), 6) AS value FROM orders GROUP BY ALL),
entries AS (
  SELECT f.family, f.variant, f.value, f.value AS raw, coalesce(p.canonical_variant = f.variant, FALSE) AS canonical, p.family IS NULL AS needs_policy,
    CASE coalesce(p.round_mode, 'half_up') WHEN 'half_even' THEN round_even(CAST(f.value AS DECIMAL(18, 6)), 1) WHEN 'floor' THEN floor(f.value)
      ELSE CASE p.decimals WHEN 2 THEN round(CAST(f.value AS DECIMAL(18, 6)), 2) ELSE round(CAST(f.value AS DECIMAL(18, 6)), 4) END END AS display
  FROM figures f LEFT JOIN policy p ON p.family = f.family)"""


def _figures(t: Tables):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return t.orders.groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("variant")).agg(
        F.round(cents / 100.0 / F.count("*"), 6).alias("value"))


# Each family is made by one script and reads two inputs; texts of documents stand in for their contents.
PROVENANCE_SQL = FIGURES + """,
made AS (SELECT e.*, 'share' AS unit, 'ratio' AS estimator, CAST(ascii(family) - 48 AS BIGINT) AS script_id, [10 + ascii(family) - 48, 20 + (ascii(family) - 48) % 3] AS input_ids FROM entries e)"""


def _contents(t: Tables, text=None):
    return t.documents.select(F.col("doc_id").cast("string").alias("name"), F.sha2((text if text is not None else F.col("text")).cast("binary"), 256).alias("sha"))


def _new_figures(t: Tables):
    place = F.ascii("family") - 48
    inputs = F.array((place + 10).cast("string"), (place % 3 + 20).cast("string"))
    named = _figures(t).withColumns({"script": place.cast("string"), "input_names": inputs, "unit": F.lit("share"), "estimator": F.lit("ratio"), "emitted_at": F.lit("2024-01-02")})
    return RG.with_provenance(named, _contents(t), _contents(t))


def _entries(t: Tables):
    return RG.emit(t.spark.createDataFrame([], RG.ENTRY), _new_figures(t), _policy(t))


@query("r01_emit_figures", oracle("""
  SELECT family, variant, value, display, canonical, needs_policy, unit, estimator, CAST(script_id AS VARCHAR) AS script, s.sha AS script_sha,
    list_transform(input_ids, lambda i: CAST(i AS VARCHAR)) AS input_names, [a.sha, b.sha] AS input_shas, CASE WHEN variant = 'P' THEN '2024-01-01' ELSE '2024-01-02' END AS emitted_at
  FROM made JOIN shas s ON s.doc_id = script_id JOIN shas a ON a.doc_id = input_ids[1] JOIN shas b ON b.doc_id = input_ids[2] UNION ALL
  SELECT 'gone', variant, value, display, canonical, needs_policy, unit, estimator, CAST(script_id AS VARCHAR), s.sha,
    list_transform(input_ids, lambda i: CAST(i AS VARCHAR)), [a.sha, b.sha], '2024-01-01'
  FROM made JOIN shas s ON s.doc_id = script_id JOIN shas a ON a.doc_id = input_ids[1] JOIN shas b ON b.doc_id = input_ids[2] WHERE family = '5-LOW' AND variant = 'O'""",
    "", PROVENANCE_SQL + ", shas AS (SELECT doc_id, sha256(text) AS sha FROM documents)", dbl="value display"))
def _(t):
    first = _entries(t).withColumn("emitted_at", F.lit("2024-01-01"))
    # Before, another script had made all but the P figures, or an input had other content.
    old = first.withColumn("script_sha", F.when(F.col("variant") == "F", "s0").otherwise(F.col("script_sha")))
    other = F.transform("inputs", lambda i: F.struct(i["name"].alias("name"), F.lit("0").alias("sha")))
    old = old.withColumn("inputs", F.when(F.col("variant") == "O", other).otherwise(F.col("inputs")))
    gone = first.filter("family = '5-LOW' AND variant = 'O'").withColumn("family", F.lit("gone"))
    out = RG.emit(old.unionByName(gone), _new_figures(t), _policy(t))
    return out.withColumns({"input_names": F.col("inputs.name"), "input_shas": F.col("inputs.sha")}).drop("inputs")


@query("r02_stale_entries", oracle("""
  SELECT family, variant, CAST(script_id AS VARCHAR) AS name, CASE WHEN script_id = 4 THEN 'producer missing' ELSE 'producer changed' END AS reason FROM made WHERE script_id % 2 = 0 UNION ALL
  SELECT family, variant, CAST(i AS VARCHAR), CASE WHEN i % 4 = 0 THEN 'input missing' ELSE 'input changed' END FROM (SELECT family, variant, unnest(input_ids) AS i FROM made) WHERE i % 2 = 0""",
    "", PROVENANCE_SQL))
def _(t):
    entries = _entries(t)
    number = F.col("doc_id")
    changed = F.when(number % 2 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    now = _contents(t, changed).filter("CAST(name AS INT) % 4 <> 0")
    return RG.stale_entries(entries, now, now).select("family", "variant", "name", "reason")


# Text lines derived from orders: each order is one line of a document per customer.
LINE_SQL = """
lines AS (SELECT o_custkey AS file, o_orderkey AS line, CASE o_orderkey % 10
  WHEN 0 THEN 'mean CANON: ' || fam || '.' || o_orderstatus || ' = ' || CAST(round(o_totalprice / 1000.0, 1) AS VARCHAR)
  WHEN 1 THEN 'mean canon ' || fam || ' = 4.6'
  WHEN 2 THEN 'two CANON: ' || fam || '.F = 12.5 variant-ok and CANON: other.x = ~3'
  WHEN 3 THEN 'plain text with 3.25 inside'
  WHEN 4 THEN 'CANON: ' || fam || ' = × 1.123456'
  WHEN 5 THEN 'CANON: lo.P = 7'
  WHEN 6 THEN 'CANON: ' || fam || '.P = ,, variant-ok'
  WHEN 8 THEN 'CANON: fine.P = 9.99 and CANON: fine = 1.25'
  WHEN 9 THEN 'CANON: odd.P = 9.99'
  ELSE 'no figure here' END AS text FROM (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'lo' END AS fam FROM orders) AS o),
hits AS (SELECT file, line, unnest(regexp_extract_all(text, 'CANON:\\s*([\\w.\\-]+)\\s*=\\s*([~×xX]?\\s*[-0-9.,]+)(\\s+variant-ok)?', 1)) AS key,
  trim(unnest(regexp_extract_all(text, 'CANON:\\s*([\\w.\\-]+)\\s*=\\s*([~×xX]?\\s*[-0-9.,]+)(\\s+variant-ok)?', 2))) AS cited,
  coalesce(unnest(regexp_extract_all(text, 'CANON:\\s*([\\w.\\-]+)\\s*=\\s*([~×xX]?\\s*[-0-9.,]+)(\\s+variant-ok)?', 3)), '') <> '' AS variant_ok FROM lines),
bad AS (SELECT file, line, text FROM lines WHERE regexp_matches(text, '(?i)\\bcanon\\b') AND contains(text, '=')
  AND NOT regexp_matches(text, 'CANON:\\s*([\\w.\\-]+)\\s*=\\s*([~×xX]?\\s*[-0-9.,]+)(\\s+variant-ok)?')),
reg AS (SELECT * FROM (VALUES ('urgent', 'F', 12.5), ('urgent', 'O', 13.25), ('high', 'F', 12.5), ('high', 'P', 4.0), ('medium', 'F', 1.1), ('lo', 'P', 7.0), ('fine', 'P', 1.25), ('odd', 'P', 1.25)) AS r(family, variant, value)),
pol AS (SELECT * FROM (VALUES ('urgent', 'F', 1, 'half_up'), ('high', 'P', 2, 'half_up'), ('lo', 'P', 0, 'half_up'), ('fine', 'P', 8, 'half_up'), ('odd', 'P', 2, 'ceil')) AS p(family, canonical_variant, decimals, mode)),
resolved AS (
  SELECT h.*, coalesce(f.family, c.family) AS family, coalesce(f.variant, c.variant) AS variant, coalesce(f.value, c.value)::DOUBLE AS value, f.family IS NULL AND c.family IS NOT NULL AS by_family FROM hits h
  LEFT JOIN reg f ON f.family || '.' || f.variant = h.key LEFT JOIN (SELECT r.* FROM reg r JOIN pol p ON p.family = r.family AND p.canonical_variant = r.variant) AS c ON c.family = h.key),
parsed AS (
  SELECT r.*, p.canonical_variant, p.decimals, p.mode, try_cast(CASE WHEN contains(s, ',') AND contains(s, '.') THEN replace(s, ',', '') ELSE s END AS DOUBLE) AS num,
    length(regexp_extract(cited, '\\.([0-9]+)\\s*$', 1)) AS cited_decimals
  FROM (SELECT *, replace(regexp_replace(trim(cited), '^[×xX~]+', ''), ' ', '') AS s FROM resolved) AS r LEFT JOIN pol p ON p.family = r.family)"""

REG = [("urgent", "F", 12.5), ("urgent", "O", 13.25), ("high", "F", 12.5), ("high", "P", 4.0), ("medium", "F", 1.1), ("lo", "P", 7.0), ("fine", "P", 1.25), ("odd", "P", 1.25)]
POL = [("urgent", "F", 1, "half_up"), ("high", "P", 2, "half_up"), ("lo", "P", 0, "half_up"), ("fine", "P", 8, "half_up"), ("odd", "P", 2, "ceil")]


def _lines(t: Tables):
    first = F.substring("o_orderpriority", 1, 1)
    fam = F.when(first == "1", "urgent").when(first == "2", "high").when(first == "3", "medium").otherwise("lo")
    k = F.col("o_orderkey") % 10
    text = (
        F.when(k == 0, F.concat(F.lit("mean CANON: "), fam, F.lit("."), "o_orderstatus", F.lit(" = "), F.round(F.col("o_totalprice") / 1000.0, 1).cast("string")))
        .when(k == 1, F.concat(F.lit("mean canon "), fam, F.lit(" = 4.6")))
        .when(k == 2, F.concat(F.lit("two CANON: "), fam, F.lit(".F = 12.5 variant-ok and CANON: other.x = ~3")))
        .when(k == 3, "plain text with 3.25 inside").when(k == 4, F.concat(F.lit("CANON: "), fam, F.lit(" = × 1.123456")))
        .when(k == 5, "CANON: lo.P = 7").when(k == 6, F.concat(F.lit("CANON: "), fam, F.lit(".P = ,, variant-ok")))
        .when(k == 8, "CANON: fine.P = 9.99 and CANON: fine = 1.25").when(k == 9, "CANON: odd.P = 9.99").otherwise("no figure here"))
    return t.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), text.alias("text"))


def _registry(t: Tables):
    pol = literal_rows(t.spark, POL, "family string, canonical_variant string, decimals int, round_mode string")
    reg = literal_rows(t.spark, REG, "family string, variant string, value double").join(pol, "family", "left").select(
        "family", "variant", "value", F.coalesce(F.col("canonical_variant") == F.col("variant"), F.lit(False)).alias("canonical"), F.col("canonical_variant").isNull().alias("needs_policy"))
    return reg, pol


@query("r03_find_anchors", oracle(
    "SELECT file, line, key, cited, variant_ok FROM hits UNION ALL SELECT file, line, NULL, trim(text), NULL FROM bad", "", LINE_SQL))
def _(t):
    bad = RG.malformed_anchors(_lines(t)).select("file", "line", F.lit(None).cast("string").alias("key"), F.col("text").alias("cited"), F.lit(None).cast("boolean").alias("variant_ok"))
    return RG.find_anchors(_lines(t)).unionByName(bad)


@query("r04_resolve_keys", oracle("SELECT file, line, key, cited, family, variant, value, by_family FROM resolved", "", LINE_SQL, dbl="value"))
def _(t):
    reg, pol = _registry(t)
    return RG.resolve(RG.find_anchors(_lines(t)), reg, pol).select("file", "line", "key", "cited", "family", "variant", "value", "by_family")


@query("r05_check_anchors", oracle("""
  SELECT file, line, key, violation, violation <> 'stale' AS blocking FROM (
    SELECT file, line, key, CASE WHEN family IS NULL THEN 'unknown key' WHEN canonical_variant IS NULL THEN 'no policy'
      WHEN NOT by_family AND canonical_variant <> variant AND NOT variant_ok THEN 'variant not canonical' WHEN num IS NULL THEN 'unreadable value'
      WHEN cited_decimals > decimals THEN 'too many decimals' WHEN mode = 'ceil' THEN 'no official value' WHEN num <> round(value, decimals) THEN 'value differs' WHEN family = 'lo' THEN 'stale' END AS violation FROM parsed
    UNION ALL SELECT file, line, NULL, 'malformed' FROM bad) AS v WHERE violation IS NOT NULL""", "", LINE_SQL))
def _(t):
    reg, pol = _registry(t)
    stale = reg.filter("family = 'lo'").select("family", "variant")
    return RG.check(_lines(t), reg, pol, stale)


@query("r06_audit_numbers", oracle("""
  SELECT doc_id AS file, line, text FROM numbered n WHERE regexp_matches(text, '(^|[^\\w.])[×xX~]?\\s*[0-9]+\\.[0-9]+') AND NOT EXISTS (
    SELECT 1 FROM numbered m WHERE m.doc_id = n.doc_id AND m.line BETWEEN n.line - 1 AND n.line + 1 AND contains(m.text, 'CANON:'))""", "", """
numbered AS (SELECT doc_id, i AS line, CASE WHEN (doc_id + i) % 5 = 0 THEN parts[i] || ' CANON: a = 1' WHEN (doc_id + i) % 4 = 0 THEN parts[i] || ' 2.50' ELSE parts[i] END AS text FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) AS a) AS b)""", ints="line"))
def _(t):
    lines = number_lines(t.documents, "doc_id", "text")
    k = F.col("file") + F.col("line")
    text = F.when(k % 5 == 0, F.concat("text", F.lit(" CANON: a = 1"))).when(k % 4 == 0, F.concat("text", F.lit(" 2.50"))).otherwise(F.col("text"))
    return RG.unanchored_numbers(lines.withColumn("text", text))


@query("r07_reproduction_gate", oracle("""
  SELECT e.family, e.variant, f.value, e.expected, e.tolerance, f.value - e.expected AS difference FROM (VALUES ('1-URGENT', 'F', 250000.0::DOUBLE, 1.0::DOUBLE), ('5-LOW', 'O', 250000.0, 1e9), ('5-LOW', 'Z', 1.0, 1.0)) AS e(family, variant, expected, tolerance)
  LEFT JOIN figures f ON f.family = e.family AND f.variant = e.variant WHERE f.value IS NULL OR abs(f.value - e.expected) > e.tolerance""", "", FIGURES,
    dbl="value expected tolerance difference", digits=4), digits=4)
def _(t):
    expected = literal_rows(t.spark, [("1-URGENT", "F", 250000.0, 1.0), ("5-LOW", "O", 250000.0, 1e9), ("5-LOW", "Z", 1.0, 1.0)],
                            "family string, variant string, expected double, tolerance double")
    return RG.reproduction_gate(_figures(t), expected, ["family", "variant"])


@query("st01_streaming_cells", oracle("""
  SELECT epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS start, event_type, sum(w) AS sw, sum(w * w) AS sw2, sum(w * r) AS swd, count(*) AS n FROM (
    SELECT ts, event_type, floor(value) AS w, event_id % 2 AS r FROM events) AS e GROUP BY ALL""", ints="start n", dbl="sw sw2 swd"))
def _(t):
    schema = t.events.schema
    stream = ST.read_events(t.spark, f"{t.folder}/events.parque[t]", schema)
    d = stream.withColumns({"w": F.floor("value").cast("double"), "r": (F.col("event_id") % 2).cast("int")})
    out = ST.drain(ST.windowed_cells(d, "ts", "event_type", "w", "r", "1 day", None), ["start", "end", "event_type"])
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "sw", "sw2", "swd", "n")
