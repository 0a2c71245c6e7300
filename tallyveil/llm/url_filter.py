"""URL filter with redirect equivalence.

Rules (host, path, verdict) fit their host and its subdomains where the url's path starts with the rule's; the
longest rule wins. Urls joined by a redirect or a canonical link are aliases: connected components over those
links carry a block to every alias that no rule covers, unless an alias is explicitly allowed.

Links come from ``page_links`` (canonical links and refresh redirects inside the html) or from any table of
(source, target) urls, such as a crawler's redirect log. Targets inside the html may be relative: character references
are decoded, then targets are resolved against the page's base href, else its url, and lose their dot segments. The
SQL below knows absolute targets and ``&amp;`` only; no given table has others. Components are found by the library's distributed
minimum-label rounds; nothing is gathered on the driver.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no alias, and is
allowed. Rules with an empty host never fit. Of equally long rules the one with the longer host wins, then a
block. Repeated rows keep their number. Columns of the pages table other than the named ones are left out.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm.common import fits_broadcast, table, written
from tallyveil.llm.decontaminate import once
from tallyveil.operators.graph import components

#: The rules of the registered query.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: A rule list up to this length is broadcast (at most about 20 MB); a longer one is joined by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """A url without scheme and fragment, its host in lower case: the node of the alias graph; null without a host."""
    query = F.regexp_extract(url_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), url_path(url), query))


def decode_references(value: Column) -> Column:
    """An attribute's text with its character references decoded, each once."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    # Numbers 128 to 159 stand for the characters of windows-1252, as browsers read them.
    odd = F.from_json(F.lit(json.dumps({str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)})), "map<string,string>")

    def number(piece: Column, code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.coalesce(odd[code.cast("string")], F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("�")
        return F.concat(char, F.regexp_replace(piece, r"^&(?:#[xX][0-9a-fA-F]+|#[0-9]+);?", ""))

    def named(piece: Column, name: Column) -> Column:
        return once(names[name], lambda char: F.when(char.isNull(), piece).otherwise(F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece)))))

    def decoded(piece: Column) -> Column:
        digits16 = F.ltrim(F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
        code = F.when(piece.rlike("^&#[0-9]"), F.regexp_extract(piece, r"^&#([0-9]+)", 1).try_cast("bigint")).when(F.length(digits16) <= 8, F.conv(digits16, 16, 10).try_cast("bigint"))
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*(?:;|(?=[^=A-Za-z0-9;])|$))", 1)
        return F.when(piece.rlike("^&#([0-9]|[xX][0-9a-fA-F])"), once(code, lambda c: number(piece, c))).otherwise(once(name, lambda n: named(piece, n)))

    return F.when(value.contains("&"), F.array_join(F.transform(F.split(value, "(?=&)"), decoded), "")).otherwise(value)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments carried out."""
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def walked(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: (
            F.when(part.rlike(two), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part.rlike(one), done).otherwise(F.array_append(done, part))
        ))
        ends = F.element_at(parts, -1).rlike(f"{one}|{two}")
        return once(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(ends & (F.size(k) > 0), "/").otherwise("")))

    return once(F.split(F.substring(path, 2, F.length(path)), "/"), walked)


def resolve(target: Column, base: Column) -> Column:
    """The absolute url that ``target`` means on a page with the url ``base``; null where there is none."""
    site = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"

    def joined(t: Column, b: Column) -> Column:
        head, path = F.regexp_extract(b, site, 1), F.regexp_extract(b, site + r"([^?#]*)", 2)
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(~b.rlike(site), None)
            .when(t.startswith("//"), F.concat(F.regexp_extract(b, r"^([^:]*:)", 1), t)).when(t.startswith("/"), F.concat(head, t))
            .when(t.startswith("?"), F.concat(head, path, t)).when(t.startswith("#"), F.concat(F.regexp_extract(b, r"^[^#]*", 0), t))
            .otherwise(F.concat(head, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), t))
        )

    def cleaned(url: Column) -> Column:
        path, rest = F.regexp_extract(url, site + r"([^?#]*)", 2), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
        path = once(path, lambda p: F.when(p.startswith("/"), without_dots(p)).otherwise(p))
        return F.when(url.rlike(site), F.concat(F.regexp_extract(url, site, 1), path, rest))

    return once(target, lambda t: once(base, lambda b: once(joined(t, b), cleaned)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of canonical links and refresh redirects in the pages' html, as absolute urls."""
    canonical = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")
    )
    refresh = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")
    )
    targets = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    named = F.filter(
        F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<base\b[^>]*>"), F.lit(0)), lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        lambda t: t != "",
    )
    # A page without either word has no such link; most pages need no pattern at all.
    likely = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    found = pages.filter(likely).select(F.col(url).alias("source"), F.get(named, 0).alias("base"), F.explode(targets).alias("target")).filter("target <> ''")
    base = F.coalesce(resolve(decode_references(F.col("base")), F.col("source")), F.col("source"))
    found = found.withColumn("base", base).withColumn("target", decode_references(F.col("target")))
    # Written, or every later use of a target would repeat the whole expression in the plan.
    return written(found.select("source", resolve(F.col("target"), F.coalesce("base", F.lit(""))).alias("target")), "page-links").filter("target IS NOT NULL")


def fit_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) rows of ``urls`` with the ``rule`` that fits best and its ``verdict``; others are left out.

    Every host ending is paired with the path prefixes that have a rule's length, and looked up by equality, so a
    large rule list is an ordinary join on (host, path).
    """
    listed = rules.filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    # Path lengths of rules are a handful of small numbers.
    lengths = listed.agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    tried = (
        urls.select("host", "path").distinct().filter("host <> ''").crossJoin(F.broadcast(lengths))
        .select("host", "path", F.explode(endings).alias("rule_host"), "lengths")
        .select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("_n"))
        .select("host", "path", "rule_host", F.expr("substring(path, 1, _n)").alias("rule_path"))
    )
    small = F.broadcast(listed) if fits_broadcast(listed, BROADCAST_RULES) else listed
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("a"), F.length("rule_host").alias("b"), F.col("verdict").alias("verdict"), rule.alias("rule")))
    return tried.join(small, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("m")).select("host", "path", "m.rule", "m.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns with host, path, rule, verdict and alias group of every row's url."""
    # Columns named like the result's give way to it.
    rows = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), alias_key(F.col(url)).alias("_node"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    edges = links.select(alias_key(F.col("source")).alias("source"), alias_key(F.col("target")).alias("target"), F.col("target").alias("_t"), F.col("source").alias("_s"))
    edges = edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()
    groups = components(edges.select("source", "target"))
    # Aliases outside the pages table carry their rules, too.
    ends = edges.select(F.explode(F.array("_s", "_t")).alias("u")).select(alias_key(F.col("u")).alias("node"), url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path")).distinct()
    decided = fit_rules(rows.select("host", "path").unionByName(ends.select("host", "path")), rules)
    votes = (
        groups.join(ends, "node").join(decided, ["host", "path"]).groupBy("component")
        .agg(F.max(F.col("verdict") == "allow").alias("_allowed"), F.max(F.col("verdict") == "block").alias("_blocked"))
    )
    alias = groups.join(votes, "component", "left").select(F.col("node").alias("_node"), F.col("component").alias("alias_group"), "_allowed", "_blocked")
    method = F.when(F.col("_blocked") & ~F.col("_allowed"), "block").otherwise("allow")
    return (
        rows.join(decided, ["host", "path"], "left").join(alias, "_node", "left")
        .select(*keep, "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "alias_group")
    )


def op2_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, page_links(pages)).drop("alias_group")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {
    "op2_url_verdicts": rf"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES {_RULES_SQL}),
found AS (
  SELECT url AS s, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')),
      lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
      lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t
  FROM pages),
links AS (SELECT s, replace(t, '&amp;', '&') AS t FROM found WHERE t LIKE '%://%'),
urls AS (SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT s FROM links UNION ALL SELECT t FROM links)),
parts AS (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM urls),
split AS (SELECT u, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS q FROM parts),
nodes AS (SELECT u, host, path, CASE WHEN host <> '' THEN host || path || q END AS node FROM split),
fits AS (SELECT u, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM nodes, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY u),
steps AS (SELECT a.node AS x, b.node AS y FROM links JOIN nodes a ON a.u = s JOIN nodes b ON b.u = t
  UNION SELECT b.node, a.node FROM links JOIN nodes a ON a.u = s JOIN nodes b ON b.u = t),
reach(x, y) AS (SELECT x, y FROM steps UNION SELECT r.x, s.y FROM reach r JOIN steps s ON r.y = s.x),
votes AS (SELECT x, bool_or(v = 'allow') AS ok, bool_or(v = 'block') AS bad FROM reach JOIN nodes n ON n.node = y JOIN fits f ON f.u = n.u GROUP BY x)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule,
  coalesce(f.v, CASE WHEN w.bad AND NOT w.ok THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN nodes n ON n.u = p.url LEFT JOIN fits f ON f.u = p.url LEFT JOIN votes w ON w.x = n.node
""",
}
QUERIES = {"op2_url_verdicts": op2_url_verdicts}
