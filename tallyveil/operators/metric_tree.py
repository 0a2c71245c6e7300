"""Exact nearest neighbours over a tree of pivots that grows with the data.

Points are unit vectors and their distance is the angle between them. Nodes with more than ``block`` targets are split
among pivots drawn from their own members, level by level, until leaves are small; queries descend to the leaf of
their nearest pivots. A first pass searches each query's own leaf and so bounds how far its neighbours can be. A second
pass goes down the tree and keeps only leaves that the triangle inequality does not rule out for a leaf's queries; only such
pairs of leaves are shipped, as one row each. Neither pivots nor leaves are collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.vectors import dot
from tallyveil.operators.ordering import top_rows
from tallyveil.session import cut_lineage

#: Node lists up to so many rows are broadcast; longer ones are joined with salted keys.
FEW_NODES, SALTS = 10_000, 64
#: What arccos loses near zero.
SLACK = 1e-7


def _spread_join(rows: DataFrame, few: DataFrame, count: int) -> DataFrame:
    """Rows with what is known about their node, if anything; no node's rows meet in one task."""
    if count <= FEW_NODES:
        return rows.join(F.broadcast(few), "node", "left")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["node", "_salt"], "left").drop("_salt")


def grow(points: DataFrame, block: int, fan: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """Points with ``node`` (their leaf) and ``angle`` to its pivot, and the tree's levels: (parent, node, pivot, radius).

    ``points``: key (unique), vec (unit vector), target, query (booleans) and columns that are carried along.
    """
    kinds = dict(points.dtypes)
    state = cut_lineage(points.withColumns({"node": F.lit(0).cast("bigint"), "angle": F.lit(0.0)}))
    total = state.filter("target").count()
    most = 3 + math.ceil(math.log(max(total / block, 1)) / math.log(fan))
    out = f"{', '.join(f'`{c}` {k}' for c, k in kinds.items())}, node bigint, angle double"
    levels: list[DataFrame] = []

    def assign(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows.drop(columns=["part"])
        pivots = np.stack([np.asarray(p, float) for p in given["pivots"].iloc[0]])
        cos = np.clip(np.stack(rows["vec"].to_numpy()) @ pivots.T, -1.0, 1.0)
        # Points as near to several pivots are dealt among them, or orthogonal points would never part.
        near = cos >= cos.max(axis=1, keepdims=True) - 1e-12
        pick = rows["deal"].to_numpy() % near.sum(axis=1)
        best = (np.cumsum(near, axis=1) > pick[:, None]).argmax(axis=1)
        return rows.drop(columns=["part", "deal"]).assign(node=rows["node"] * fan + 1 + best, angle=np.arccos(cos[np.arange(len(best)), best]))

    while len(levels) < most:
        sizes = state.groupBy("node").agg(F.count_if("target").alias("targets"), F.count("*").alias("all_rows")).filter(F.col("targets") > block)
        # Leaves of about half a block; a leaf with too few members would tell its queries nothing.
        want = F.least(F.lit(fan), F.ceil(2 * F.col("targets") / block)).cast("int").alias("want")
        sizes = cut_lineage(sizes.select("node", F.ceil(F.col("all_rows") / block).cast("int").alias("parts"), want))
        splits = sizes.count()
        if not splits:
            break
        marked = _spread_join(state, sizes, splits)
        open_rows = marked.filter("parts IS NOT NULL")
        drawn = top_rows(open_rows.filter("target").select("node", "key", "vec", "want"), ["node"], [F.xxhash64("key"), F.col("key")], fan).filter("position <= want")
        pivots = cut_lineage(drawn.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "vec"))), lambda p: p["vec"]).alias("pivots")))
        copies = pivots.join(sizes, "node").select(F.col("node").alias("at"), "pivots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("copy"))
        dealt = open_rows.withColumns({"part": F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), "deal": F.pmod(F.xxhash64("key", F.lit("deal")), F.lit(1 << 30))}).drop("parts", "want")
        moved = dealt.groupBy("node", "part").cogroup(copies.groupBy("at", "copy")).applyInPandas(assign, out)
        moved = cut_lineage(moved)
        radius = moved.filter("target").groupBy("node").agg(F.max("angle").alias("radius"))
        children = pivots.select(F.col("node").alias("parent"), F.posexplode("pivots").alias("i", "pivot")).withColumn("node", F.col("parent") * fan + 1 + F.col("i"))
        levels.append(cut_lineage(children.join(radius, "node").select("parent", "node", "pivot", "radius")))
        state = marked.filter("parts IS NULL").drop("parts", "want").unionByName(moved)
    return state, levels


def _packed(rows: DataFrame, block: int, columns: Sequence[str], name: str) -> DataFrame:
    """Rows of a leaf, at most about ``block`` in one row."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).filter("_parts > 1")
    sizes = cut_lineage(sizes)
    parts = _spread_join(rows, sizes, sizes.count())
    part = F.pmod(F.xxhash64("key"), F.coalesce("_parts", F.lit(1))).cast("int")
    stats = [F.max("angle").alias("reach"), *([F.max("limit").alias("limit")] if "limit" in rows.columns else [])]
    return parts.withColumn("part", part).groupBy("node", "part").agg(F.collect_list(F.struct(*columns)).alias(name), *stats)


def visits(chunks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Pairs (home, part, node, pivot, radius): leaves that may hold a neighbour of a chunk's queries, its home left out.

    ``chunks``: node, part, pivot of their home, reach and limit, the largest angles of their queries to that pivot and to a neighbour.
    """
    empty = chunks.select(F.col("node").alias("home"), "part", "node", "pivot", F.lit(0.0).alias("radius"))
    if not levels:
        return empty.limit(0)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    parents = nodes.select(F.col("parent").alias("node")).distinct()
    open_now, found = chunks.select(F.col("node").alias("home"), "part", F.col("pivot").alias("own"), "reach", "limit", F.lit(0).cast("bigint").alias("at")), None
    for depth, level in enumerate(levels):
        below = level.withColumnRenamed("parent", "at")
        # The root has at most ``fan`` children.
        joined = open_now.join(F.broadcast(below) if depth == 0 else below, "at")
        apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("own"), F.col("pivot")))))
        kept = joined.filter(apart - F.col("reach") - F.col("radius") <= F.col("limit") + SLACK)
        kept = cut_lineage(kept.join(parents.withColumn("inner", F.lit(True)), "node", "left"))
        ends = kept.filter("inner IS NULL AND node <> home").select("home", "part", "node", "pivot", "radius")
        found = ends if found is None else found.unionByName(ends)
        open_now = kept.filter("inner").select("home", "part", "own", "reach", "limit", F.col("node").alias("at"))
    return found


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.StructArray, pa.StructArray], dict[str, pa.Array]]


def _matrix(rows: pa.StructArray) -> np.ndarray:
    vec = rows.field("vec")
    return np.asarray(vec.flatten(), float).reshape(len(rows), -1)


def _searched(pairs: DataFrame, search: Search, schema: str) -> DataFrame:
    """Results of every pair row: ``asked`` and ``held`` arrays, and with a pivot only the queries that can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, held, pivots, radius = (batch.column(batch.schema.get_field_index(n)) for n in ("asked", "held", "pivot", "radius"))
            for i in range(batch.num_rows):
                a, b = asked[i].values, held[i].values
                q, limit = _matrix(a), np.asarray(a.field("limit"), float)
                if pivots[i].is_valid:
                    angle = np.arccos(np.clip(q @ np.asarray(pivots[i].values, float), -1.0, 1.0))
                    keep = angle - radius[i].as_py() <= limit + SLACK
                    if not keep.any():
                        continue
                    a, q, limit = a.filter(pa.array(keep)), q[keep], limit[keep]
                result = search(q, _matrix(b), limit, a, b)
                yield pa.RecordBatch.from_arrays(list(result.values()), names=list(result))

    return pairs.select("asked", "held", "pivot", "radius").mapInArrow(run, schema)


def nearest(points: DataFrame, search: Search, schema: str, limits: Callable[[DataFrame], DataFrame], *, block: int, start: Column, carry: Sequence[str] = ()) -> DataFrame:
    """All results of ``search`` that can be among a query's nearest.

    ``search`` takes query and target vectors, the queries' limits (angles) and both sides' rows with ``carry``, and returns columns of
    ``schema``, ``key`` among them. ``limits`` makes (key, found) of the first pass's results: the angle beyond which nothing is wanted;
    ``start`` is that angle before anything is known.
    """
    leaves, levels = grow(points, block)
    held = _packed(leaves.filter("target"), block, ["key", "vec", *carry], "held").select("node", F.col("part").alias("held_part"), "held")
    held = cut_lineage(held)
    asked = leaves.filter("query").withColumn("limit", start)
    none = F.lit(None).cast(dict(points.dtypes)["vec"])
    home = _packed(asked, block, ["key", "vec", "limit", *carry], "asked").join(held, "node").withColumns({"pivot": none, "radius": F.lit(0.0)})
    first = cut_lineage(_searched(home, search, schema))
    if not levels:
        return first
    bounded = asked.join(limits(first), "key", "left").withColumn("limit", F.least("limit", F.coalesce("found", "limit"))).drop("found")
    pivots = levels[0].select("node", "pivot")
    for level in levels[1:]:
        pivots = pivots.unionByName(level.select("node", "pivot"))
    chunks = cut_lineage(_packed(bounded, block, ["key", "vec", "limit", *carry], "asked").join(pivots, "node"))
    pairs = visits(chunks.drop("asked"), levels)
    shipped = pairs.join(chunks.select(F.col("node").alias("home"), "part", "asked"), ["home", "part"]).join(held, "node")
    return first.unionByName(_searched(shipped, search, schema))
