"""Merkle manifest of a table: digests of rows, of runs of them, of every group and of the whole, with checked proofs.

Every row is a leaf. Inside its group (here: the language) a leaf has a rank, and every node is labelled with the half-open
interval of leaf ranks it covers; a leaf covers [rank, rank + 1). Nodes of one level lie in buckets of that level's width, so
the node that contains an interval is found by joining on (group, bucket) with the two bounds compared; what lies in a
parent's interval but not in the node's own is its siblings: those before it and those behind it.

Levels are built bottom up, eight nodes to a parent, and written; ancestors are attached top down, each level joining the one
above, where a key has eight rows at most, so the root of a group with most rows never meets all of them. Groups' roots form
the leaves of one more tree of the same kind, whose paths are put on top of the groups'.

Defined results: leaves of a group ascend by id (null first), then by digest; repeated rows are leaves of their own; a null
group is a group, the first; a table with one row has that leaf as its root and the digest of nothing as proof; rows with
a null id are not tampered with; null fields count as ``-`` and stay null when tampered; texts of any length are hashed whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import table, written
from tallyveil.operators.ordering import positions

FAN = 8
#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def framed(value: Column) -> Column:
    """A field so that no two lists of fields read alike: ``-`` or the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def lowered(text: Column) -> Column:
    """A-Z to a-z, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _siblings(inside: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds besides [lo, hi): digests before and behind, each side joined."""
    before = F.filter(inside, lambda c: c["hi"] <= lo)
    behind = F.filter(inside, lambda c: c["lo"] >= hi)
    return F.struct(*[F.array_join(F.transform(side, lambda c: c["digest"]), "").alias(n) for side, n in ((before, "before"), (behind, "behind"))])


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes over intervals of ``width`` leaf ranks, each with its children in order."""
    child = F.struct("lo", "hi", "digest", *([F.col("item")] if "item" in nodes.columns else []))
    runs = nodes.groupBy("grp", "n", F.expr(f"lo div {width}").alias("bucket")).agg(F.sort_array(F.collect_list(child)).alias("inside"))
    joined = digest(F.array_join(F.transform("inside", lambda c: c["digest"]), ""))
    # A lone leaf is its group's root as it is.
    own = F.when(F.col("n") == 1, F.col("inside")[0]["digest"]).otherwise(joined)
    return runs.select("grp", "n", F.col("inside")[0]["lo"].alias("lo"), F.element_at("inside", -1)["hi"].alias("hi"), "bucket", own.alias("digest"), "inside")


def interval_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels above the leaves (grp, n, lo, hi, digest, item), lowest first: (grp, n, lo, hi, bucket, digest, inside)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    width, found = FAN, []
    while not found or width < most * FAN:
        below = leaves if not found else found[-1].filter("hi - lo < n")
        found.append(written(_parents(below, width), f"merkle-{width}"))
        width *= FAN
    return found


def whole_groups(found: list[DataFrame]) -> DataFrame:
    """(grp, digest) of the nodes that cover their group."""
    tops = [level.filter("hi - lo = n").select("grp", "digest") for level in found]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def attach_paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves (grp, lo, item, digest) with ``path``, their siblings level by level, and the columns of ``tops``.

    ``tops`` (grp, above, ...) goes on top of each group's own path.
    """
    kept = [c for c in tops.columns if c not in ("grp", "above")]
    attached, width = None, FAN ** (len(found) + 1)  # of the level above
    for level in reversed(found):
        roots = level.filter("hi - lo = n").join(tops, "grp").select("grp", "lo", "hi", "bucket", "inside", F.col("above").alias("path"), *kept)
        if attached is not None:
            parent = attached.select("grp", "bucket", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("inside").alias("p_inside"), F.col("path").alias("p_path"), *kept)
            inner = level.filter("hi - lo < n").select("grp", "lo", "hi", F.expr(f"lo div {width}").alias("bucket"), F.col("bucket").alias("own"), "inside")
            contained = inner.join(parent, ["grp", "bucket"]).filter("p_lo <= lo AND hi <= p_hi")
            path = F.concat(F.array(_siblings(F.col("p_inside"), F.col("lo"), F.col("hi"))), F.col("p_path"))
            roots = roots.unionByName(contained.select("grp", "lo", "hi", F.col("own").alias("bucket"), "inside", path.alias("path"), *kept))
        attached, width = roots, width // FAN
    leaves = attached.withColumn("leaf", F.explode("inside"))
    own = F.when(F.size("inside") > 1, F.array(_siblings(F.col("inside"), F.col("leaf.lo"), F.col("leaf.hi"))))
    # A run of one is hashed like any other, unless it is a group of one.
    single = F.when((F.size("inside") == 1) & (F.col("leaf.lo") > 0), F.array(F.struct(F.lit("").alias("before"), F.lit("").alias("behind"))))
    none = F.expr("cast(array() AS array<struct<before:string,behind:string>>)")
    return leaves.select("grp", F.col("leaf.lo").alias("lo"), F.col("leaf.item").alias("item"), F.col("leaf.digest").alias("digest"), F.concat(F.coalesce(own, single, none), "path").alias("path"), *kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda got, s: F.sha2(F.concat(s["before"], got, s["behind"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings on the path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), ""))


def merkle_manifest(rows: DataFrame, group: str, key: str, leaf: Column, tampered: Column) -> DataFrame:
    """Every row's (key, group, leaf_rank, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``tampered`` is the digest of the row as it is found later; the proof folds it instead of ``leaf``.
    """
    # Equals sign before each value: null groups come first, and are a key like others.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    slim = written(rows.select(grp.alias("grp"), F.col(group).alias("_group"), F.col(key).alias("_key"), leaf.alias("digest"), tampered.alias("found")), "merkle-leaves")
    ranked = positions(slim, ["grp"], [F.col("_key").asc_nulls_first(), F.col("digest")])
    lo = F.col("position") - 1
    item = F.struct(F.col("_key").alias("key"), F.col("_group").alias("group"), "found")
    own = interval_levels(ranked.select("grp", F.col("group_rows").alias("n"), lo.alias("lo"), F.col("position").alias("hi"), "digest", item.alias("item")))
    # One row for each group: their roots are the leaves of the upper tree.
    roots = whole_groups(own).select(F.lit("").alias("all"), "grp", "digest")
    order = positions(roots, ["all"], [F.col("grp")])
    upper = interval_levels(order.select(F.col("all").alias("grp"), F.col("group_rows").alias("n"), lo.alias("lo"), F.col("position").alias("hi"), "digest", F.col("grp").alias("item")))
    none = F.expr("cast(array() AS array<struct<before:string,behind:string>>)")
    summit = whole_groups(upper).select("grp", F.col("digest").alias("root"), none.alias("above"))
    tops = written(attach_paths(upper, summit).select(F.col("item").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("above")), "merkle-tops")
    fold = folded(F.col("item.found"), F.col("path"))
    return (
        attach_paths(own, tops)
        .select(F.col("item.key").alias(key), F.col("item.group").alias(group), F.col("lo").alias("leaf_rank"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op13_merkle_manifest(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_digest(list(fields.values()))
    tampered = F.when(hit, leaf_digest(list((fields | {"text": lowered(F.col("text"))}).values()))).otherwise(leaf)
    return merkle_manifest(docs, "lang", "doc_id", leaf, tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", "leaf_rank")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of an ASCII text, bit by bit; the constants are those of the published checksum."""
    step = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), {step}, xor(a, ascii(s)::BIGINT))"
    return f"xor(list_reduce(string_split({text}, ''), lambda a, s: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(text if f == "text" else f) for f in FIELDS) + ")"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIDES = """coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind"""
ORACLES = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, {_leaf_sql('text')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf_sql(_LOWER_SQL)} ELSE {_leaf_sql('text')} END AS found
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM hashed
),
up AS (
  SELECT grp, CAST(0 AS BIGINT) AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY grp, level, n, idx // 8
),
up_sides AS (SELECT *, {_SIDES} FROM up),
subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS groups FROM up WHERE n = 1),
top AS (
  SELECT '' AS grp, CAST(0 AS BIGINT) AS level, place AS idx, groups AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT grp, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY grp, level, n, idx // 8
),
top_sides AS (SELECT *, {_SIDES} FROM top),
climb AS (
  SELECT grp, idx AS leaf_rank, CAST(0 AS BIGINT) AS level, idx, n, found AS got, '' AS siblings FROM leaves
  UNION ALL
  SELECT c.grp, c.leaf_rank, c.level + 1, c.idx // 8, (c.n + 7) // 8, sha256(s.before || c.got || s.behind), c.siblings || s.before || s.behind
  FROM climb c JOIN up_sides s ON c.grp = s.grp AND c.level = s.level AND c.idx = s.idx WHERE c.n > 1
),
rest AS (
  SELECT c.grp, c.leaf_rank, CAST(0 AS BIGINT) AS level, r.place AS idx, r.groups AS n, c.got, c.siblings FROM climb c JOIN subroots r ON c.grp = r.grp WHERE c.n = 1
  UNION ALL
  SELECT c.grp, c.leaf_rank, c.level + 1, c.idx // 8, (c.n + 7) // 8, sha256(s.before || c.got || s.behind), c.siblings || s.before || s.behind
  FROM rest c JOIN top_sides s ON c.level = s.level AND c.idx = s.idx WHERE c.n > 1
)
SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, sha256(e.siblings) AS proof_sha256, e.got AS folded_root, e.got = t.digest AS verified, l.lang, l.idx AS leaf_rank
FROM leaves l JOIN subroots r ON l.grp = r.grp JOIN rest e ON e.grp = l.grp AND e.leaf_rank = l.idx AND e.n = 1 JOIN top t ON t.n = 1
""",
}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
