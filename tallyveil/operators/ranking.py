"""Rank correlation and top-share metrics of predictions against targets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions import special
from tallyveil.functions.codes import finite_pair
from tallyveil.operators.ordering import average_ranks, positions
from tallyveil.session import cut_lineage

MIN_CELLS = 5  # fixed value: smallest district that is scored
#: Groups of up to so many distinct pairs are ranked in one task.
RANK_PAIRS = 500_000


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """M-01 / M-02: Spearman correlation with average ranks per group: (keys, rho, n).

    NULL with fewer than ``min_rows`` finite pairs or a constant side. Pairs are counted
    before anything is ranked; groups of very many pairs are spread over slices, where AQE splits a rank value shared by very many.
    """
    keys = list(keys)
    kept = df.filter(finite_pair(F.col(x), F.col(y)))
    # Written once: the pairs are counted, and feed both rankings.
    pairs = cut_lineage(kept.groupBy(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).agg(F.count("*").alias("_n")))
    if not keys:
        return _sliced_spearman(pairs, keys, min_rows)
    large = cut_lineage(pairs.groupBy(*keys).agg(F.count("*").alias("_pairs")).filter(F.col("_pairs") > RANK_PAIRS).select(*keys))
    if large.isEmpty():
        return _grouped_spearman(pairs, keys, min_rows)
    # At most one row per RANK_PAIRS pairs.
    rest = _grouped_spearman(pairs.join(large, keys, "left_anti"), keys, min_rows)
    return rest.unionByName(_sliced_spearman(pairs.join(large, keys, "left_semi"), keys, min_rows))


def _correlated(ranked: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """(keys, rho, n) of distinct pairs with their number, ranks and the group's rows."""
    centre = (F.col("group_rows") + 1) / 2.0
    dx, dy, n = F.col("_rx") - centre, F.col("_ry") - centre, F.col("_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(n * dx * dy).alias("_xy"),
        F.sum(n * dx * dx).alias("_xx"),
        F.sum(n * dy * dy).alias("_yy"),
    )
    usable = (F.col("n") >= min_rows) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    rho = F.when(usable, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*keys, rho.alias("rho"), "n")


def _grouped_spearman(pairs: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Groups of at most ``RANK_PAIRS`` pairs are placed by their keys once and ranked by plain windows."""
    known = pairs
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    place = W.partitionBy(*keys)

    def rank(c: str) -> Column:
        upto = F.sum("_n").over(place.orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow))
        return upto - (F.sum("_n").over(W.partitionBy(*keys, c)) - 1) / 2.0

    ranked = known.repartition(*keys).select(*keys, "_n", rank("_x").alias("_rx"), rank("_y").alias("_ry"), F.sum("_n").over(place).alias("group_rows"))
    return _correlated(ranked, keys, min_rows)


def _sliced_spearman(pairs: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Groups of any size, each spread over many slices."""
    rank_x = average_ranks(pairs, keys, "_x", "_n").select(*keys, "_x", F.col("rank").alias("_rx"), "group_rows")
    rank_y = average_ranks(pairs, keys, "_y", "_n").select(*keys, "_y", F.col("rank").alias("_ry"))
    return _correlated(pairs.join(rank_x, [*keys, "_x"]).join(rank_y, [*keys, "_y"]), keys, min_rows)


def grouped_rho(place: np.ndarray, x: np.ndarray, y: np.ndarray, min_rows: int = 3) -> Iterator[tuple[int, float, int]]:
    """``spearman`` of rows inside a task: (group, rho, n) of the groups, numbered by ``place``, that have one."""
    with np.errstate(invalid="ignore"):
        known = np.isfinite(x) & np.isfinite(y)
    place, x, y = place[known], x[known], y[known]
    rows = np.bincount(place)
    start = np.cumsum(rows) - rows

    def centred(v: np.ndarray) -> np.ndarray:
        low = v.min(initial=np.inf)
        if len(v) and (v.max() - low) * len(rows) < 4 * len(v) and (v == np.floor(v)).all():
            # Whole numbers of a short range are counted instead of sorted.
            span = int(v.max() - low) + 1
            at = place * span + (v - low).astype(np.int64)
            ties = np.bincount(at, minlength=span * len(rows))
            ends = np.cumsum(ties)
            return ((ends - ties + 1 + ends) / 2.0)[at] - start[place] - (rows[place] + 1) / 2.0
        order = np.lexsort((v, place))
        first = np.append(True, (np.diff(v[order]) != 0) | (np.diff(place[order]) != 0))[: len(v)]
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(v))
        out = np.empty(len(v))
        out[order] = np.repeat((begins + 1 + ends) / 2.0, ends - begins)
        return out - start[place] - (rows[place] + 1) / 2.0

    dx, dy = centred(x), centred(y)
    xy, xx, yy = (np.bincount(place, v) for v in (dx * dy, dx * dx, dy * dy))
    for g in np.flatnonzero((rows >= min_rows) & (xx > 0) & (yy > 0)):
        yield int(g), float(xy[g] / np.sqrt(xx[g] * yy[g])), int(rows[g])


def area_correlations(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]], min_rows: int = 3) -> DataFrame:
    """Several Spearman correlations at once for tables with one row per area: (keys, names, n).

    A group is bounded by the area list, so plain windows are enough. Rows are placed by the
    keys once; every window and the final aggregation reuse that placement. ``n`` counts the
    finite pairs of the first correlation.
    """
    keys = list(keys)
    placed = df.repartition(*keys)
    for name, (x, y) in pairs.items():
        placed = placed.withColumn(f"_ok_{name}", finite_pair(F.col(x), F.col(y)))

    def avg_rank(c: str, ok: str) -> Column:
        ties = F.count("*").over(W.partitionBy(*keys, ok, c))
        rank = F.rank().over(W.partitionBy(*keys, ok).orderBy(c)) + (ties - 1) / 2.0
        return F.when(F.col(ok), rank)

    ranked = placed.select(*keys, *[
        avg_rank(c, f"_ok_{name}").alias(f"_{side}_{name}") for name, xy in pairs.items() for side, c in zip("xy", xy)
    ])
    sums = []
    for name in pairs:
        x, y = f"_x_{name}", f"_y_{name}"
        sums += [F.count(x).alias(f"_n_{name}"), F.stddev_pop(x).alias(f"_sx_{name}"), F.stddev_pop(y).alias(f"_sy_{name}"),
                 F.covar_pop(x, y).alias(f"_cov_{name}")]
    grouped = ranked.groupBy(*keys).agg(*sums)

    def rho(name: str) -> Column:
        usable = (F.col(f"_n_{name}") >= min_rows) & (F.col(f"_sx_{name}") > 0) & (F.col(f"_sy_{name}") > 0)
        return F.when(usable, F.col(f"_cov_{name}") / (F.col(f"_sx_{name}") * F.col(f"_sy_{name}"))).alias(name)

    return grouped.select(*keys, *[rho(n) for n in pairs], F.col(f"_n_{next(iter(pairs))}").alias("n"))


def spearman_of_areas(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """M-01 / M-02 for tables with one row per area."""
    return area_correlations(df, keys, {"rho": (x, y)}, min_rows)


def with_p_value(correlations: DataFrame) -> DataFrame:
    """M-03."""
    return correlations.withColumn("p_value", special.spearman_p(F.col("rho"), F.col("n")))


def supported_groups(df: DataFrame, keys: Sequence[str], pred: str, target: str, min_rows: int = MIN_CELLS) -> DataFrame:
    """P-05: keys with enough rows, two distinct targets and two distinct predictions.

    Two distinct values exist exactly when min and max differ; that needs no distinct shuffle.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(target).alias("_t0"), F.max(target).alias("_t1"),
             F.min(pred).alias("_p0"), F.max(pred).alias("_p1"))
        .filter((F.col("_n") >= min_rows) & (F.col("_t0") < F.col("_t1")) & (F.col("_p0") < F.col("_p1")))
        .select(*keys)
    )


def keep_supported(df: DataFrame, keys: Sequence[str], pred: str, target: str, min_rows: int = MIN_CELLS) -> DataFrame:
    return df.join(supported_groups(df, keys, pred, target, min_rows), list(keys), "left_semi")


def within_district(df: DataFrame, pred: str, target: str = "target", keys: Sequence[str] = ("category", "district"),
                    min_rows: int = MIN_CELLS) -> DataFrame:
    """M-04: rank correlation inside every (category, district) that has enough support."""
    return spearman(df, keys, pred, target, min_rows).filter("rho IS NOT NULL")


def macro(stats: DataFrame, value: str, category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    """M-05 / M-16: mean over categories of the mean over districts."""
    per_category = stats.groupBy(*by, category).agg(F.avg(value).alias("_m"))
    return per_category.groupBy(*by).agg(F.avg("_m").alias(f"macro_{value}"), F.count("_m").alias("categories"))


def _decile(rows: Column, rule: str, share: float = 0.10) -> Column:
    size = F.lit(share) * rows
    return F.greatest(F.lit(1), (F.bround(size) if rule == "round" else F.ceil(F.round(size, 9))).cast("bigint"))


def _gain(target: str) -> Column:
    return F.sum(F.col(target) / F.log2(F.col("position") + 1))


def top_share(df: DataFrame, keys: Sequence[str], pred: str, target: str, tie: str, rule: str = "round",
              share: float = 0.10) -> DataFrame:
    """M-06 / M-07 / M-11: share of the target in the top decile of predictions.

    ``rule`` is ``round`` (half-even, inside districts) or ``ceil`` (whole category).
    Ties are broken by the ``tie`` column.
    """
    ranked = positions(df, keys, [F.col(pred).desc(), F.col(tie)])
    k = _decile(F.col("group_rows"), rule, share)
    taken = F.sum(F.when(F.col("position") <= k, F.col(target)).otherwise(0.0))
    total = F.sum(target)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n_cells"),
        F.max(k).alias("k"),
        F.when(total > 0, taken / total).alias("capture"),
    )


def per_capita(df: DataFrame, columns: Sequence[str], population: str = "population") -> DataFrame:
    """M-08: divide by population, rows without population are left out."""
    return df.filter(F.col(population) > 0).withColumns({c: F.col(c) / F.col(population) for c in columns})


def ndcg(df: DataFrame, keys: Sequence[str], pred: str, target: str, tie: str) -> DataFrame:
    """M-14: gain = target, discount = 1/log2(rank + 1), over the full ranking."""
    keys = list(keys)

    def gain(order: list[Column], name: str) -> DataFrame:
        ranked = positions(df.select(*keys, pred, target, tie), keys, order)
        return ranked.groupBy(*keys).agg(_gain(target).alias(name))

    got = gain([F.col(pred).desc(), F.col(tie)], "_dcg")
    best = gain([F.col(target).desc(), F.col(tie)], "_best")
    return got.join(best, keys).select(*keys, F.when(F.col("_best") > 0, F.col("_dcg") / F.col("_best")).alias("ndcg"))


def nmae(df: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    """M-15: sum of absolute errors over the target sum."""
    total = F.sum(target)
    return df.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.abs(F.col(pred) - F.col(target))) / total).alias("nmae"),
        F.count("*").alias("n_cells"), total.alias("target_sum"), F.sum(pred).alias("pred_sum"),
    )


def metric_pack(df: DataFrame, pred: str, target: str = "target", category: str = "category",
                district: str = "district", tie: str = "cell", by: Sequence[str] = ()) -> DataFrame:
    """M-10: one row per category with global and within-district metrics; ``by`` keeps models or folds apart.

    Categories without events are skipped (P-11).
    """
    keys = [*by, category]
    # Written before they are summed, so that what they come from is computed once.
    rows = cut_lineage(df.select(*keys, district, tie, pred, target))
    live = cut_lineage(rows.groupBy(*keys).agg(F.sum(target).alias("_s")).filter("_s > 0").select(*keys))
    d = rows.join(F.broadcast(live), keys, "left_semi")
    base = nmae(d, keys, pred, target)
    overall = spearman(d, keys, pred, target).select(*keys, F.col("rho").alias("spearman_global"))
    # One ranking by prediction serves the global recall and the discounted gain.
    ranked = positions(d, keys, [F.col(pred).desc(), F.col(tie)])
    taken = F.sum(F.when(F.col("position") <= _decile(F.col("group_rows"), "ceil"), F.col(target)).otherwise(0.0))
    by_pred = ranked.groupBy(*keys).agg((taken / F.sum(target)).alias("recall10"), _gain(target).alias("_dcg"))
    by_target = positions(d.select(*keys, target, tie), keys, [F.col(target).desc(), F.col(tie)])
    best = by_target.groupBy(*keys).agg(_gain(target).alias("_best"))
    gains = by_pred.join(best, keys).select(*keys, "recall10", (F.col("_dcg") / F.col("_best")).alias("ndcg"))
    inside = within_district(d, pred, target, (*keys, district)).groupBy(*keys).agg(
        F.avg("rho").alias("intra_spearman"), F.count("*").alias("intra_districts")
    )
    local = top_share(d, [*keys, district], pred, target, tie, "round").groupBy(*keys).agg(
        F.avg("capture").alias("intra_recall10")
    )
    out = base
    for part in (overall, gains, inside, local):
        out = out.join(part, keys, "left")
    return out.withColumn("intra_pai", F.col("intra_recall10") / F.lit(0.10))


def overlap_at_k(df: DataFrame, keys: Sequence[str], pred: str, target: str, tie: str, ceiling: int = 100) -> DataFrame:
    """M-17: MAE and overlap of the two top-k sets, k = min(ceiling, n // 5)."""
    keys = list(keys)
    by_target = positions(df, keys, [F.col(target).desc(), F.col(tie)]).withColumnRenamed("position", "_pt")
    both = positions(by_target.drop("group_rows"), keys, [F.col(pred).desc(), F.col(tie)])
    k = F.least(F.lit(ceiling), F.floor(F.col("group_rows") / 5)).cast("bigint")
    hits = F.sum(F.when((F.col("position") <= k) & (F.col("_pt") <= k), 1).otherwise(0))
    return both.groupBy(*keys).agg(
        F.count("*").alias("n_cells"), F.max(k).alias("k"),
        F.avg(F.abs(F.col(pred) - F.col(target))).alias("mae"),
        (hits / F.nullif(F.max(k), F.lit(0))).alias("overlap"),
    ).filter("n_cells >= 5")


def rank_shift(df: DataFrame, keys: Sequence[str], a: str, b: str, tie: str) -> DataFrame:
    """W-05 / W-06: row rank in two orderings and the shift (positive = moves up in ``b``)."""
    first = positions(df, keys, [F.col(a).desc(), F.col(tie)]).drop("group_rows").withColumnRenamed("position", "rank_a")
    second = positions(first, keys, [F.col(b).desc(), F.col(tie)]).drop("group_rows")
    return second.withColumnRenamed("position", "rank_b").withColumn("shift", F.col("rank_a") - F.col("rank_b"))


def conservation_error(df: DataFrame, pred: str, target: str = "target", category: str = "category",
                       district: str = "district") -> DataFrame:
    """M-37: squared error of district totals, scaled by category mean times sqrt(n + 1)."""
    known = df.filter(F.col(target).isNotNull())
    totals = known.groupBy(category, district).agg(
        F.sum(target).alias("_t"), F.sum(pred).alias("_p"), F.sum(F.abs(F.col(target))).alias("_a"), F.count("*").alias("_n")
    )
    # The scale is summed from the district totals, not from a second pass over the rows.
    scale = totals.groupBy(category).agg((F.sum("_a") / F.sum("_n")).alias("_scale"))
    scale = scale.withColumn("_scale", F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0))
    error = ((F.col("_p") - F.col("_t")) / (F.col("_scale") * F.sqrt(F.col("_n") + 1.0))) ** 2
    return totals.join(scale, category).groupBy(district).agg(F.avg(error).alias("error"), F.count("*").alias("categories"))


