"""Citation graphs over a bounded core, and exact vector neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.codes import salton
from tallyveil.functions.vectors import l2_normalise
from tallyveil.operators.metric_tree import nearest
from tallyveil.operators.ordering import top_rows
from tallyveil.session import cut_lineage

#: Vector search: leaves of a half to a whole ``1 / COPIES`` of the vectors up to a bound, and queries compared at once.
COPIES, MOST_BLOCK, SEARCH_ROWS = 16, 32_768, 256


def select_seeds(papers: DataFrame, size: int, marked: str | None = None, citations: str = "citations", key: str = "paper") -> DataFrame:
    """G-04: the marked members, or the ``size`` most cited papers."""
    if marked is not None:
        return papers.filter(marked).select(key)
    return papers.orderBy(F.coalesce(citations, F.lit(0)).desc(), key).limit(size).select(key)


def snowball(refs: DataFrame, citers: DataFrame, seeds: DataFrame, size: int, least: int = 2) -> DataFrame:
    """G-05: papers cited by or citing the seeds, seeds excluded, score >= 2; seeds and they make up to ``size``.

    ``refs`` and ``citers`` are (paper, other) edges with ``paper`` on the seed side.
    """
    back = refs.join(seeds, "paper", "left_semi").select("other")
    forward = citers.join(seeds, "paper", "left_semi").select("other")
    scored = back.unionByName(forward).groupBy(F.col("other").alias("paper")).agg(F.count("*").alias("score"))
    kept = scored.join(seeds, "paper", "left_anti").filter(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), "paper").limit(max(0, size - seeds.count()))


def shared_counts(links: DataFrame, core: DataFrame) -> DataFrame:
    """J-13: number of shared items per pair of core members: (a, b, shared, size_a, size_b).

    ``links`` is (paper, other). The core is bounded by the size parameter of the core
    selection, so an item shared by the whole core yields at most size^2 / 2 pairs and
    only links of core members are shuffled.
    """
    own = cut_lineage(links.join(core.select("paper"), "paper", "left_semi").select("paper", "other").distinct())
    sizes = own.groupBy("paper").agg(F.count("*").alias("n"))
    a, b = own.select(F.col("paper").alias("a"), "other"), own.select(F.col("paper").alias("b"), "other")
    pairs = a.join(b, "other").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    left = sizes.select(F.col("paper").alias("a"), F.col("n").alias("size_a"))
    right = sizes.select(F.col("paper").alias("b"), F.col("n").alias("size_b"))
    return pairs.join(left, "a").join(right, "b")


def salton_edges(links: DataFrame, core: DataFrame) -> DataFrame:
    """G-06: shared items normalised by the geometric mean of both list lengths."""
    c = shared_counts(links, core)
    weight = salton(F.col("shared"), F.col("size_a"), F.col("size_b"))
    return c.select(F.col("a").alias("source"), F.col("b").alias("target"), "shared", weight.alias("weight"))


def direct_citations(refs: DataFrame, core: DataFrame) -> DataFrame:
    """J-14: citations between core members, without self citations."""
    inside = refs.join(core.select("paper"), "paper", "left_semi")
    other = core.select(F.col("paper").alias("other"))
    return inside.join(other, "other", "left_semi").filter("paper <> other").select(
        F.col("paper").alias("source"), F.col("other").alias("target")
    ).distinct()


def combined_similarity(coupling: DataFrame, cocitation: DataFrame, alpha: float = 0.5) -> DataFrame:
    """G-07: alpha x coupling + (1 - alpha) x co-citation over the union of both edge tables."""
    left = coupling.select("source", "target", F.col("weight").alias("_c"))
    right = cocitation.select("source", "target", F.col("weight").alias("_o"))
    weight = F.lit(alpha) * F.coalesce("_c", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("_o", F.lit(0.0))
    return left.join(right, ["source", "target"], "full_outer").select("source", "target", weight.alias("weight"))


def isolated_nodes(core: DataFrame, similarity: DataFrame) -> DataFrame:
    """G-07: core members whose similarities add up to nothing."""
    ends = similarity.filter("weight > 1e-9").select(F.explode(F.array("source", "target")).alias("paper"))
    return core.select("paper").join(ends.distinct(), "paper", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by repeated minimum labels: (node, component).

    Each round also follows the label of the label, so long chains shrink quickly. Rounds
    are checkpointed; the loop ends only when no label moved.
    """
    both = cut_lineage(edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other")),
    )).alias("e")).select("e.node", "e.other"))
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    moving = not labels.isEmpty()
    while moving:
        seen = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(
            F.min("component").alias("_near")
        )
        step = labels.join(seen, "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        moved = cut_lineage(step.join(jump, "component", "left").select(
            "node", F.least("component", F.coalesce("_far", F.col("component"))).alias("component"), "_old"
        ))
        labels = moved.select("node", "component")
        moving = not moved.filter("component <> _old").isEmpty()
    return labels


def communities(core: DataFrame, similarity: DataFrame, threshold: float = 0.1) -> DataFrame:
    """G-08: average-linkage communities cut at distance 1 - threshold: (paper, community).

    Average linkage is reducible: merging two clusters never brings a third one nearer than the
    nearer of the two. So all pairs of mutual nearest clusters are merged in one round, which gives
    the same tree as one merge at a time, and a round is a handful of joins and sums on (a, b, sum
    of similarities). Equal similarities are taken by the smaller pair of ids. A community is
    named by its smallest paper. Isolated papers get a NULL community; with fewer than three
    connected papers all are isolated.
    """
    if threshold <= 0:
        raise ValueError("the similarity threshold must be positive")
    live = cut_lineage(similarity.filter("weight > 1e-9").select("source", "target", "weight"))
    # Every pair stands in both directions, so that each cluster sees all its neighbours.
    total = cut_lineage(live.unionByName(live.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
                        .groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.sum("weight").alias("total")).filter("a <> b"))
    label = cut_lineage(total.select(F.col("a").alias("paper")).distinct().withColumn("community", F.col("paper")))
    while True:
        size = label.groupBy("community").agg(F.count("*").alias("n"))
        pairs = total.join(size.select(F.col("community").alias("a"), F.col("n").alias("n_a")), "a").join(
            size.select(F.col("community").alias("b"), F.col("n").alias("n_b")), "b"
        ).withColumn("link", F.col("total") / (F.col("n_a") * F.col("n_b")))
        # One order of all pairs, the same from both sides: the first pair of all is always mutual.
        rank = F.struct(-F.round("link", 12), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        best = pairs.filter(F.col("link") >= threshold - 1e-12).groupBy("a").agg(F.min_by("b", rank).alias("b"))
        mutual = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).filter("a < b")
        merged = cut_lineage(mutual.select(F.col("b").alias("community"), F.col("a").alias("into")))
        if merged.isEmpty():
            break
        label = cut_lineage(label.join(merged, "community", "left").select("paper", F.coalesce("into", "community").alias("community")))
        for end in ("a", "b"):
            total = total.join(merged.withColumnRenamed("community", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        total = cut_lineage(total.filter("a <> b").groupBy("a", "b").agg(F.sum("total").alias("total")))
    enough = label.agg((F.count("*") >= 3).alias("_enough"))
    out = core.select("paper").join(label, "paper", "left").crossJoin(enough)
    return out.select("paper", F.when(F.col("_enough"), F.col("community")).alias("community"))


def community_sizes(members: DataFrame) -> DataFrame:
    """G-09: number of communities of three or more, of pairs, and of isolated papers."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    known = F.col("community").isNotNull()
    return sizes.agg(
        F.count_if(known & (F.col("n") >= 3)).alias("large"), F.count_if(known & (F.col("n") == 2)).alias("pairs"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("isolated"),
    )


def community_leaders(members: DataFrame, papers: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """G-09: the n most cited members of every community of at least ``least`` papers."""
    big = members.filter("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("members")).filter(F.col("members") >= least)
    listed = members.join(papers.select("paper", "citations"), "paper").join(big, "community")
    ranked = top_rows(listed, ["community"], [F.coalesce("citations", F.lit(0)).desc(), F.col("paper")], n)
    return ranked.select("community", "members", "position", "paper")


def nearest_vectors(vectors: DataFrame, k: int, min_sim: float = -1.0, block: int = 2048) -> DataFrame:
    """J-15, first part: the k most similar vectors of every vector: (id, other, sim, place).

    Exact, by the pivot tree of ``metric_tree``: a vector's own leaf first, then the leaves that can hold something as similar as
    its k-th there. Equal vectors are searched once; of a group of copies only the first k + 1 ids can ever be listed. Ties
    at the border go to the smaller ids, so a query keeps k + 1 rows per visited leaf.

    Vectors without structure visit most leaves, and each visit ships a leaf's queries. So leaves grow with the data: there are about
    ``2 * COPIES`` of them, however many vectors, up to ``MOST_BLOCK`` vectors a block; ``block`` is the least.
    """
    unit = vectors.select("id", l2_normalise(F.col("vec")).alias("vec"))
    unit = unit.withColumn("key", F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256))
    ids = cut_lineage(unit.select("id", "key", "vec"))
    block = max(block, min(ids.select("key").distinct().count() // COPIES, MOST_BLOCK))
    first = ids.groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("tie"), F.count("*").alias("copies"))
    members = top_rows(ids.select(F.col("key").alias("other_key"), F.col("id").alias("other")), ["other_key"], [F.col("other")], k + 1).drop("position")
    kind = dict(vectors.dtypes)["id"]

    def search(q: np.ndarray, t: np.ndarray, limit: np.ndarray, asked: pa.StructArray, held: pa.StructArray) -> dict[str, pa.Array]:
        # Columns in the order of their smallest ids, so that equal similarities are told apart by place.
        order = pc.sort_indices(held.field("tie")).to_numpy()
        sorted_t = t[order].T
        rows, places, kept = [], [], []
        for s in range(0, len(q), SEARCH_ROWS):
            sims = q[s : s + SEARCH_ROWS] @ sorted_t
            least = np.maximum(np.maximum(np.cos(limit[s : s + SEARCH_ROWS]), min_sim) - 2e-9, min_sim)
            hit = sims >= least[:, None]
            if len(order) > k + 1 and np.count_nonzero(hit) > 8 * (k + 1) * len(sims):
                hit &= sims >= -np.partition(-sims, k, axis=1)[:, k : k + 1] - 2e-9
            i, j = np.nonzero(hit)
            best = np.lexsort((j, -np.rint(sims[i, j] * 1e9), i))
            i, j = i[best], j[best]
            listed = np.arange(len(i)) - np.searchsorted(i, i) <= k
            i, j = i[listed], j[listed]
            rows.append(i + s)
            places.append(j)
            kept.append(sims[i, j])
        i, j = np.concatenate(rows), np.concatenate(places)
        other = held.take(pa.array(order[j]))
        return {"key": asked.field("key").take(pa.array(i)), "other_key": other.field("key"), "tie": other.field("tie"), "sim": pa.array(np.concatenate(kept))}

    def limits(found: DataFrame) -> DataFrame:
        # With its own key a vector has k + 1 rows; the smallest of them bounds what else can be listed.
        worst = top_rows(found.select("key", "sim", "tie"), ["key"], [F.desc("sim"), F.col("tie")], k + 1).groupBy("key").agg(F.count("*").alias("n"), F.min("sim").alias("sim"))
        return worst.filter(F.col("n") > k).select("key", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim") - 2e-9))).alias("found"))

    both = {"target": F.lit(True), "query": F.lit(True)}
    start = F.lit(math.acos(max(-1.0, min(1.0, min_sim - 2e-9))) + 1e-7)
    found = nearest(first.select("key", "vec", "tie").withColumns(both), search, f"key string, other_key string, tie {kind}, sim double", limits, block=block, start=start, carry=["tie"])
    kept = top_rows(found, ["key"], [F.round("sim", 9).desc(), F.col("tie")], k + 1).select("key", "other_key", "sim")
    # A vector with very many copies meets its list in stretches of them.
    spread = 1 << 16
    lists = kept.join(first.select("key", F.explode(F.expr(f"sequence(0L, (copies - 1) div {spread})")).alias("stretch")), "key")
    ask = ids.select("id", "key").join(first.select("key", "copies").filter(F.col("copies") > spread), "key", "left")
    ask = ask.select("id", "key", F.pmod(F.xxhash64("id"), F.coalesce(F.expr(f"(copies - 1) div {spread} + 1"), F.lit(1).cast("bigint"))).alias("stretch"))
    listed = ask.join(lists, ["key", "stretch"]).join(members, "other_key").filter("id <> other")
    near = W.partitionBy("id").orderBy(F.round("sim", 9).desc(), "other")
    return listed.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).select("id", "other", "sim", "place")


def similarity_edges(neighbours: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """J-15, second part: undirected, de-duplicated edges between keyed nodes."""
    d = neighbours
    if keys is not None:
        a = keys.select("id", F.col("key").alias("_a"))
        b = keys.select(F.col("id").alias("other"), F.col("key").alias("_b"))
        d = d.join(a, "id").join(b, "other").filter("_a <> _b")
    else:
        d = d.withColumns({"_a": F.col("id"), "_b": F.col("other")})
    return d.groupBy(F.least("_a", "_b").alias("source"), F.greatest("_a", "_b").alias("target")).agg(F.max("sim").alias("weight"))
