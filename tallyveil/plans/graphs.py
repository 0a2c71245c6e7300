"""Bibliometric graphs, vector neighbours, term labels and lists over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.operators import corpus as C
from tallyveil.operators import graph as G
from tallyveil.operators import screening as SC
from tallyveil.plans.catalog import Tables, oracle, query
from tallyveil.plans.cleaning import tokens_sql
from tallyveil.session import cut_lineage

CORE = 90  # papers of the extended core, seeds included
SALTON = "shared / (sqrt(CAST(na AS DOUBLE) * nb) + 1e-9)"


def shared_sql(name: str, links: str) -> str:
    return f"""
  {name}_own AS (SELECT l.paper, l.other FROM {links} l SEMI JOIN core c ON c.paper = l.paper),
  {name}_size AS (SELECT paper, count(*) AS n FROM {name}_own GROUP BY paper),
  {name} AS (SELECT a, b, shared, x.n AS na, y.n AS nb FROM (
    SELECT l.paper AS a, r.paper AS b, count(*) AS shared FROM {name}_own l JOIN {name}_own r ON l.other = r.other AND l.paper < r.paper GROUP BY ALL) AS p
    JOIN {name}_size x ON x.paper = a JOIN {name}_size y ON y.paper = b)"""


BOTH = shared_sql("coupling", "refs") + "," + shared_sql("cocite", "citers") + f""",
  similarity AS (SELECT coalesce(c.a, o.a) AS source, coalesce(c.b, o.b) AS target, 0.5 * coalesce(c.w, 0) + 0.5 * coalesce(o.w, 0) AS weight
    FROM (SELECT a, b, {SALTON} AS w FROM coupling) AS c FULL JOIN (SELECT a, b, {SALTON} AS w FROM cocite) AS o ON o.a = c.a AND o.b = c.b)"""


def _core(t: Tables):
    seeds = G.select_seeds(t.papers(), 0, "selected")
    return cut_lineage(seeds.unionByName(G.snowball(t.refs(), t.citers(), seeds, CORE).select("paper")))


def _similarity(t: Tables):
    core = _core(t)
    return G.combined_similarity(G.salton_edges(t.refs(), core), G.salton_edges(t.citers(), core))


@query("j13_shared_references", oracle(
    "SELECT 'refs' AS kind, a, b, shared, na AS size_a, nb AS size_b FROM coupling UNION ALL SELECT 'citers', a, b, shared, na, nb FROM cocite",
    "refs citers core", shared_sql("coupling", "refs") + "," + shared_sql("cocite", "citers"), ints="shared size_a size_b"))
def _(t):
    core = _core(t)
    a = G.shared_counts(t.refs(), core).withColumn("kind", F.lit("refs"))
    return a.unionByName(G.shared_counts(t.citers(), core).withColumn("kind", F.lit("citers")))


@query("j14_direct_citations", oracle(
    "SELECT DISTINCT r.paper AS source, r.other AS target FROM refs r SEMI JOIN core a ON a.paper = r.paper SEMI JOIN core b ON b.paper = r.other WHERE r.paper <> r.other", "refs core"))
def _(t):
    return G.direct_citations(t.refs(), _core(t))


KNN = """
unit AS (SELECT vec_id AS id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) AS e),
near AS (SELECT id, other, sim, place FROM (
  SELECT a.id, b.id AS other, list_dot_product(a.u, b.u) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.id) AS place
  FROM unit a JOIN unit b ON a.id <> b.id) AS p WHERE place <= 5 AND sim >= 0.2),
edges AS (SELECT least(id, other) AS source, greatest(id, other) AS target, max(sim) AS weight FROM near JOIN (SELECT vec_id AS k1 FROM embeddings WHERE label <> 0) AS a ON k1 = id JOIN (SELECT vec_id AS k2 FROM embeddings WHERE label <> 0) AS b ON k2 = other GROUP BY ALL)"""


def _neighbours(t: Tables):
    return G.nearest_vectors(t.vectors(), 5, 0.2, block=256)


def _edges(t: Tables):
    keys = t.vectors().filter("label <> 0").select("id", F.col("id").alias("key"))
    return G.similarity_edges(_neighbours(t), keys)


@query("j15_vector_neighbours", oracle("SELECT id, other, sim, place FROM near", "", KNN, ints="place", dbl="sim"))
def _(t):
    return _neighbours(t)


@query("j15_similarity_edges", oracle("SELECT source, target, weight FROM edges", "", KNN, dbl="weight"))
def _(t):
    return _edges(t)


@query("l03_edge_summary", oracle("""
  SELECT count(*) AS edges, min(weight) AS min_weight, max(weight) AS max_weight, (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM edges UNION ALL SELECT target FROM edges) AS u) AS nodes FROM edges""",
    "", KNN, ints="edges nodes", dbl="min_weight max_weight"))
def _(t):
    return C.edge_summary(_edges(t))


@query("l01_top_pairs", oracle(
    f"SELECT a AS source, b AS target, round({SALTON}, 9) AS weight FROM coupling WHERE {SALTON} > 0 ORDER BY round({SALTON}, 9) DESC, a, b LIMIT 200", "refs core", shared_sql("coupling", "refs"), dbl="weight"))
def _(t):
    edges = G.salton_edges(t.refs(), _core(t)).withColumn("weight", F.round("weight", 9))
    return C.top_weighted(edges.select("source", "target", "weight"), 200)


@query("l02_most_cited", oracle(
    "SELECT cluster, paper, citations, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY citations DESC, paper) AS rn FROM papers) AS p WHERE rn <= 3",
    "papers", ints="citations position"))
def _(t):
    return C.most_cited(t.papers().select("cluster", "paper", "citations"), ["cluster"], "citations", "paper", 3)


TERMS = f"""
tok AS (SELECT doc_id, lang AS cluster, unnest({tokens_sql('text', True)}) AS term FROM documents),
pairs AS (SELECT doc_id, cluster, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM pairs GROUP BY term HAVING count(*) > 1),
scored_terms AS (SELECT cluster, p.term, sum(tf) AS tf, any_value(d.df) AS df, sum(tf) * ln((SELECT count(*) FROM documents) / (1.0 + any_value(d.df))) AS score FROM pairs p JOIN df d ON d.term = p.term GROUP BY cluster, p.term),
top_terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS position FROM scored_terms) AS s WHERE position <= 8)"""


def _terms(t: Tables):
    return C.cluster_terms(t.documents.select("doc_id", "text", F.col("lang").alias("cluster")), "doc_id", "text", "cluster", 8)


@query("g01_cluster_terms", oracle("SELECT cluster, term, tf, df, score, position FROM top_terms", "", TERMS, ints="tf df position", dbl="score", digits=5), digits=5)
def _(t):
    return _terms(t)


@query("g02_flag_clusters", oracle(
    "SELECT cluster, array_to_string(list_sort(list(term)), ' ') AS terms, bool_or(term IN ('ouen', 'aux', 'ung')) AS flagged FROM top_terms GROUP BY cluster", "", TERMS))
def _(t):
    return C.flag_clusters(_terms(t), "cluster", ["ouen", "aux", "ung"]).select("cluster", F.array_join("terms", " ").alias("terms"), "flagged")


@query("g03_cluster_report", oracle("""
  SELECT m.cluster, members, marked, terms, most_cited FROM (SELECT lang AS cluster, count(*) AS members, count(*) FILTER (WHERE q.quality = 1) AS marked FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id GROUP BY lang) AS m
  LEFT JOIN (SELECT cluster, string_agg(term, ', ' ORDER BY position) AS terms FROM top_terms GROUP BY cluster) AS w ON w.cluster = m.cluster
  LEFT JOIN (SELECT lang AS cluster, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY rn) AS most_cited FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) AS r WHERE rn <= 3 GROUP BY lang) AS c ON c.cluster = m.cluster""",
    "", TERMS, ints="members marked"))
def _(t):
    papers = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("cluster"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("marked"), F.col("n_chars").alias("citations"))
    return C.cluster_report(papers, "cluster", "doc_id", "marked", "citations", _terms(t))


@query("g04_seed_selection", oracle(
    "SELECT 'selected' AS mode, paper FROM papers WHERE selected UNION ALL SELECT 'topcited', paper FROM (SELECT paper FROM papers ORDER BY citations DESC, paper LIMIT 30) AS s", "papers"))
def _(t):
    a = G.select_seeds(t.papers(), 0, "selected").withColumn("mode", F.lit("selected"))
    return a.unionByName(G.select_seeds(t.papers(), 30).withColumn("mode", F.lit("topcited")))


@query("g05_snowball", oracle("""
  SELECT other AS paper, count(*) AS score FROM (
    SELECT other FROM refs WHERE paper IN (SELECT paper FROM papers WHERE selected) UNION ALL SELECT other FROM citers WHERE paper IN (SELECT paper FROM papers WHERE selected)) AS s
  WHERE other NOT IN (SELECT paper FROM papers WHERE selected) GROUP BY other HAVING count(*) >= 2
  QUALIFY row_number() OVER (ORDER BY count(*) DESC, other) <= 90 - (SELECT count(*) FROM papers WHERE selected)""", "papers refs citers", ints="score"))
def _(t):
    return G.snowball(t.refs(), t.citers(), G.select_seeds(t.papers(), 0, "selected"), CORE)


@query("g06_coupling_matrices", oracle(
    f"SELECT a AS source, b AS target, shared, {SALTON} AS weight FROM cocite", "citers core", shared_sql("cocite", "citers"), ints="shared", dbl="weight"))
def _(t):
    return G.salton_edges(t.citers(), _core(t))


@query("g07_combined_similarity", oracle("SELECT source, target, weight FROM similarity", "refs citers core", BOTH, dbl="weight"))
def _(t):
    return _similarity(t)


@query("g07_isolated_papers", oracle(
    "SELECT paper FROM core WHERE paper NOT IN (SELECT source FROM similarity WHERE weight > 0.52 UNION SELECT target FROM similarity WHERE weight > 0.52)", "refs citers core", BOTH))
def _(t):
    return G.isolated_nodes(_core(t), _similarity(t).filter("weight > 0.52"))


@query("g08_link_communities")
def _(t):
    core = _core(t)
    return G.communities(core, G.combined_similarity(G.salton_edges(t.refs(), core), G.salton_edges(t.citers(), core)), 0.15)


@query("g09_community_summary")
def _(t):
    core = _core(t)
    return G.community_sizes(G.communities(core, _similarity(t), 0.15))


@query("g10_influence_list", oracle("SELECT paper, influential FROM papers ORDER BY coalesce(influential, 0) DESC, paper LIMIT 15", "papers", ints="influential"))
def _(t):
    return C.most_cited(t.papers().select("paper", "influential"), [], "influential", "paper", 15).select("paper", "influential")


@query("g11_source_coverage", oracle("SELECT source, count(*) AS documents FROM documents GROUP BY source", ints="documents"))
def _(t):
    return C.source_coverage(t.documents, "source")


@query("g12_protocol_shares", oracle("""
  SELECT 'quality' AS protocol, CAST(sum(quality) AS BIGINT) AS papers, avg(quality) AS share, count(*) AS total FROM labels UNION ALL
  SELECT 'toxic', CAST(sum(toxic) AS BIGINT), avg(toxic), count(*) FROM labels""", ints="papers total", dbl="share"))
def _(t):
    return SC.protocol_shares(t.labels, ["quality", "toxic"])


@query("g09_community_leaders", oracle("""
  SELECT community, members, position, paper FROM (SELECT s_nationkey AS community, count(*) OVER (PARTITION BY s_nationkey) AS members, s_suppkey AS paper,
      row_number() OVER (PARTITION BY s_nationkey ORDER BY citations DESC, s_suppkey) AS position FROM supplier JOIN papers ON paper = s_suppkey) AS r WHERE members >= 3 AND position <= 5""",
    "papers", ints="community members position"))
def _(t):
    d = t.supplier.select(F.col("s_suppkey").alias("paper"), F.col("s_nationkey").alias("community"))
    return G.community_leaders(d, t.papers())


@query("g09_label_summary", oracle("""
  SELECT count(*) FILTER (WHERE label IS NOT NULL AND n >= 3) AS large, count(*) FILTER (WHERE label IS NOT NULL AND n = 2) AS pairs, coalesce(sum(CASE WHEN label IS NULL THEN n END), 0) AS isolated
  FROM (SELECT CASE WHEN s_acctbal > 0 THEN s_nationkey END AS label, count(*) AS n FROM supplier GROUP BY ALL) AS c""", ints="large pairs isolated"))
def _(t):
    d = t.supplier.select(F.col("s_suppkey").alias("paper"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("community"))
    return G.community_sizes(d)
