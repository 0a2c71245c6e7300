"""Boosted trees for many models at once, one model per key.

Rows carry keys (category, fold, setting, seed, ...), features and a target, or several targets. Every key's model is fitted on all of its
rows: equal rows are counted and their targets summed, exact bin edges come from the counts of a feature's values, and rows of equal bins are
summed into cells, all in Spark. One task grows a key's trees on its cells, which lie in files of the task's folder and are read ``fit_rows``
at a time. Models are rows of plain arrays. Prediction covers all rows: a key's rows are dealt out in parts of ``PART_ROWS``, and each part
meets one copy of its model.

Trees grow leaf by leaf on histograms of binned features (least squares, best gain first) and shrink by ``step``. Prediction reads a row's
leaf off the bits that its bins leave open.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.operators.ordering import running_totals
from tallyveil.session import cut_lineage

FIT_ROWS, PART_ROWS = 500_000, 100_000
#: Lists of models up to this length are broadcast to count their rows.
FEW_MODELS = 10_000


@dataclass(frozen=True)
class TreeSettings:
    """Settings of one model; the defaults are the published ones."""

    rounds: int = 140
    leaves: int = 15
    step: float = 0.06
    min_leaf: int = 20
    bins: int = 255
    depth: int | None = None


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers per feature, and the values up to which each bin but the last reaches."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
            edges.append(values)
        else:
            edges.append((values[:-1] + values[1:]) / 2)
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1), edges


def _alike(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each distinct row of bin numbers, and which of them every row is like."""
    place = np.zeros(len(codes), np.int64)
    for column in codes.T:
        place = np.unique(place * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1]
    return np.unique(place, return_index=True, return_inverse=True)[1:]


def alike_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of features; missing ones are alike."""
    return _alike(np.stack([np.unique(column, return_inverse=True)[1] for column in x.T], axis=1))


def _cells(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of bin numbers, how many rows have them and the sum of their targets.

    No cut can part rows of equal bins, so these sums are all that trees are grown on.
    """
    first, which = _alike(codes)
    return codes[first], np.bincount(which, minlength=len(first)).astype(float), np.bincount(which, y, len(first))


def grow(codes: np.ndarray, number: np.ndarray, total: np.ndarray, settings: TreeSettings, block: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Trees on cells (bin numbers, rows, sums of targets), ``block`` of them at a time; ``threshold`` holds numbers of bins.

    ``total`` is used up. Of cuts that gain the same up to rounding the first one is made.
    """
    parts = [slice(s, s + block) for s in range(0, len(number), block)]
    count = codes.shape[1]
    width = 1 + max(int(codes[p].max(initial=0)) for p in parts)
    base = float(total.sum() / number.sum())
    for p in parts:
        total[p] -= base * number[p]
    leaf = np.empty(len(number), np.int32) if len(parts) < 2 else np.asarray(np.memmap(tempfile.TemporaryFile(), np.int32, "w+", shape=len(number)))
    starts = np.arange(count) * width
    flat = codes + starts if len(parts) < 2 else None
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def sums(of: Sequence[np.ndarray], at: int | None = None) -> np.ndarray:
        """Sums per feature and bin in a leaf, or in all of them."""
        out = np.zeros((len(of), count, width))
        for p in parts:
            rows = slice(None) if at is None else np.flatnonzero(leaf[p] == at)
            places = (codes[p][rows] + starts if flat is None else flat[rows]).ravel()
            for w, o in zip(of, out):
                o += np.bincount(places, np.repeat(w[p][rows], count), count * width).reshape(count, width)
        return out

    def best(hist: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin) of the best cut; no gain without one."""
        if width < 2 or not count:
            return 0.0, 0, 0
        g, k = np.cumsum(hist, axis=2)
        all_g, all_k = g[:, -1:], k[:, -1:]
        g, k = g[:, :-1], k[:, :-1]
        fits = (k >= max(settings.min_leaf, 1)) & (all_k - k >= max(settings.min_leaf, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, g * g / k + (all_g - g) ** 2 / (all_k - k) - all_g * all_g / all_k, 0.0)
        top = gain.max()
        at = int((gain >= top - 1e-9 * abs(top)).argmax())
        return float(gain.flat[at]), at // (width - 1), at % (width - 1)

    def node() -> int:
        for column, start in ((feature, -1), (threshold, 0), (left, -1), (right, -1), (value, 0.0)):
            column.append(start)
        return len(feature) - 1

    def cut(at: int, f: int, b: int, low: int, high: int) -> int:
        """Deals a leaf's cells to two new ones; the one with fewer cells."""
        fewer = 0
        for p in parts:
            own = leaf[p]
            rows = np.flatnonzero(own == at)
            above = codes[p][rows, f] > b
            own[rows] = np.where(above, high, low)
            fewer += len(rows) - 2 * int(np.count_nonzero(above))
        return high if fewer > 0 else low

    whole = sums([total, number])
    for _ in range(settings.rounds):
        root = node()
        roots.append(root)
        leaf[:] = 0
        # Rows per bin are the same for every tree.
        whole[:1] = sums([total])
        gain, f, b = best(whole)
        leaves = 1
        queue = [(-gain, root, 0, f, b, whole)] if gain > 1e-12 else []
        while queue and leaves < settings.leaves:
            _, parent, level, f, b, hist = heapq.heappop(queue)
            pair = node(), node()
            feature[parent], threshold[parent] = f, b
            left[parent], right[parent] = pair
            small = cut(parent - root, f, b, *(n - root for n in pair)) + root
            hists = {small: sums([total, number], small - root)}
            hists[sum(pair) - small] = hist - hists[small]
            for child in pair:
                if settings.depth is None or level + 1 < settings.depth:
                    gain, f, b = best(hists[child])
                    if gain > 1e-12:
                        heapq.heappush(queue, (-gain, child, level + 1, f, b, hists[child]))
            leaves += 1
        nodes = len(feature) - root
        rest, rows = (sum(np.bincount(leaf[p], w[p], nodes) for p in parts) for w in (total, number))
        change = settings.step * np.divide(rest, rows, out=np.zeros(nodes), where=rows > 0)
        value[root:] = change.tolist()
        for p in parts:
            total[p] -= change[leaf[p]] * number[p]
    arrays = {"feature": np.int32, "threshold": np.float64, "below": np.int32, "above": np.int32, "value": np.float64, "roots": np.int32}
    made = dict(zip(arrays, (feature, threshold, left, right, value, roots)))
    return {"base": np.array([base])} | {n: np.array(made[n], k) for n, k in arrays.items()}


def fit(x: np.ndarray, y: np.ndarray, settings: TreeSettings) -> dict[str, np.ndarray]:
    """A boosted model as arrays; missing features take the medians of these rows, a feature without any value zero."""
    known = ~np.isnan(x)
    medians = np.array([np.median(c[k]) if k.any() else 0.0 for c, k in zip(x.T, known.T)])
    codes, edges = _binned(np.where(known, x, medians), settings.bins)
    model = grow(*_cells(codes, y), settings)
    cuts = [float(edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(model["feature"], model["threshold"])]
    return model | {"medians": medians, "threshold": np.array(cuts, float)}


#: Rows predicted at once, so that their bits stay in the processor's cache, and leaves of a tree that fit the bits.
MASK_ROWS, MASK_LEAVES, SHORT_LEAVES = 16_384, 63, 16


def _masks(model: dict[str, np.ndarray], root: int, cuts: list[np.ndarray]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Per feature and bin the leaves (bits, left to right) that a tree's cuts leave open, and the leaves' values."""
    feature, threshold, below, above = (model[n] for n in ("feature", "threshold", "below", "above"))
    leaves: list[int] = []
    open_leaves: dict[int, np.ndarray] = {}

    def visit(at: int) -> None:
        f = int(feature[at])
        if f < 0:
            leaves.append(at)
            return
        start = len(leaves)
        visit(below[at])
        shut = (1 << len(leaves)) - (1 << start)
        visit(above[at])
        mask = open_leaves.setdefault(f, np.full(len(cuts[f]) + 1, -1, np.int64))
        mask[np.searchsorted(cuts[f], threshold[at]) + 1 :] &= ~shut

    visit(root)
    kind = np.uint16 if len(leaves) <= SHORT_LEAVES else np.int64
    return [(f, mask.astype(kind)) for f, mask in open_leaves.items()], model["value"][leaves]


def _walk(model: dict[str, np.ndarray], root: int, x: np.ndarray) -> np.ndarray:
    """Values of a tree, node by node."""
    at, every = np.full(len(x), root), np.arange(len(x))
    while True:
        f = model["feature"][at]
        inner = f >= 0
        if not inner.any():
            return model["value"][at]
        low = x[every, np.maximum(f, 0)] <= model["threshold"][at]
        at = np.where(inner, np.where(low, model["below"][at], model["above"][at]), at)


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum of all trees: a row's leaf is the first one that none of its bins has shut; very large trees are walked down."""
    x = np.where(np.isnan(x), model["medians"], x)
    out = np.full(len(x), model["base"][0])
    feature, threshold, roots = model["feature"], model["threshold"], model["roots"]
    cuts = [np.unique(threshold[feature == f]) for f in range(x.shape[1])]
    sizes = (np.diff(np.append(roots, len(feature))) + 1) // 2
    trees = [_masks(model, root, cuts) if n <= MASK_LEAVES else None for root, n in zip(roots, sizes)]
    table = np.zeros((1 << (SHORT_LEAVES - 1)) + 1)
    for s in range(0, len(x), MASK_ROWS):
        part = x[s : s + MASK_ROWS]
        bins = [np.searchsorted(c, column) for c, column in zip(cuts, part.T)]
        total = out[s : s + MASK_ROWS]
        for root, tree in zip(roots, trees):
            if tree is None:
                total += _walk(model, root, part)
                continue
            masks, values = tree
            if not masks:
                total += values[0]
                continue
            bits = masks[0][1][bins[masks[0][0]]]
            for f, mask in masks[1:]:
                bits &= mask[bins[f]]
            bits &= -bits
            if bits.dtype == np.uint16:
                table[1 << np.arange(len(values))] = values
                total += table[bits]
            else:
                total += values[np.frexp(bits.astype(float))[1] - 1]
    return out


MODEL_PARTS = {"base": pa.float64(), "medians": pa.float64(), "feature": pa.int32(), "threshold": pa.float64(), "below": pa.int32(), "above": pa.int32(), "value": pa.float64(), "roots": pa.int32()}
_SPARK = {n: T.ArrayType(T.IntegerType() if k == pa.int32() else T.DoubleType()) for n, k in MODEL_PARTS.items()}


def feature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the number of rows of their key."""
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    return rows.join(F.broadcast(counts) if counts.count() <= FEW_MODELS else counts, list(keys))


def _met(rows: DataFrame, keys: Sequence[str], given: DataFrame, columns: Sequence[str]):
    """Every key's rows in parts of ``PART_ROWS``, each beside a copy of what is given for the key (``columns``)."""
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / PART_ROWS).cast("int")
    dealt = _counted(rows, keys).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_n")
    copies = given.join(counts, keys).withColumn("_copy", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    copies = copies.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "_copy", *columns)
    by = [f"_m{i}" for i in range(len(keys))]
    return dealt.groupBy(*keys, "_part").cogroup(copies.groupBy(*by, "_copy"))


def _edges(values: np.ndarray, ends: np.ndarray, known: int, missing: int, distinct: int, bins: int) -> tuple[float, np.ndarray]:
    """A feature's median and edges, as ``fit`` finds them, from its values and how many rows are up to each of them.

    Of more than ``bins`` distinct values only those around the median and those at the quantiles need be given.
    """
    if not known:
        return 0.0, np.empty(0)
    order = np.argsort(values)
    values, ends = values[order], ends[order]
    median = float(values[np.searchsorted(ends, [(known - 1) // 2, known // 2], side="right")].sum() / 2)
    if missing:
        place = int(np.searchsorted(values, median, side="right"))
        if values[place - 1] != median:
            values, ends, distinct = np.insert(values, place, median), np.insert(ends, place, ends[place - 1]), distinct + 1
            place += 1
        ends = ends + np.where(np.arange(len(ends)) >= place - 1, missing, 0)
    if distinct <= bins:
        return median, (values[:-1] + values[1:]) / 2
    at = np.floor((known + missing - 1) * (np.arange(1, bins) / bins)).astype(np.int64)
    return median, np.unique(values[np.searchsorted(ends, at, side="right")])


def _bounds(distinct: DataFrame, keys: list[str], features: list[str], bins: int) -> DataFrame:
    """Medians and edges per key, exact: values are counted and ranked over slices, and only those that make an edge are brought together."""
    spread = distinct.select(*keys, "_rows", F.posexplode(F.array(*features)).alias("_f", "_v"))
    counts = spread.groupBy(*keys, "_f", "_v").agg(F.sum("_rows").alias("_c"))
    has, none = F.col("_v").isNotNull(), F.lit(0).cast("bigint")
    measures = {"n": F.when(has, F.col("_c")).otherwise(none), "m": F.when(has, none).otherwise(F.col("_c")), "d": has.cast("bigint")}
    ranked = running_totals(counts, [*keys, "_f"], [F.col("_v")], measures)
    known, missing = F.col("all_n"), F.col("all_m")
    start = F.col("run_n") - F.when(has, F.col("_c")).otherwise(none)
    low, high = F.floor((known - 1) / 2), F.floor(known / 2)
    middle = ((start <= low) & (low < F.col("run_n"))) | ((start <= high) & (high < F.col("run_n")))
    # Rows without a value count as rows of the median: values above it move up.
    first = start + F.when(start > low, missing).otherwise(none)
    last, total = first + F.col("_c"), known + missing - 1
    near = F.floor(first * bins / F.greatest(total, F.lit(1)))

    def meets(i: Column) -> Column:
        at = F.floor(total * (i.cast("double") / F.lit(float(bins))))
        return i.between(1, bins - 1) & (first <= at) & (at < last)

    quantile = reduce(Column.__or__, [meets(near + k) for k in (-1, 0, 1, 2)])
    kept = ranked.filter((F.col("all_d") <= bins) | (known == 0) | (has & (middle | quantile)))
    schema = T.StructType([distinct.schema[k] for k in keys] + [T.StructField("medians", T.ArrayType(T.DoubleType())), T.StructField("edges", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def gather(key, group):
        columns = {c: group[c].to_numpy() for c in ("_f", "_v", "run_n", "all_n", "all_m", "all_d")}
        found = []
        for f in range(len(features)):
            own = {c: v[columns["_f"] == f] for c, v in columns.items()}
            valued = ~np.isnan(own["_v"].astype(float))
            found.append(_edges(own["_v"][valued].astype(float), own["run_n"][valued], *(int(own[c][0]) for c in ("all_n", "all_m", "all_d")), bins))
        lists = [pa.array([[m for m, _ in found]], pa.list_(pa.float64())), pa.array([[e.tolist() for _, e in found]], pa.list_(pa.list_(pa.float64())))]
        return pa.Table.from_arrays([pa.array([k.as_py()], group.schema.field(n).type) for k, n in zip(key, keys)] + lists, names=schema.names)

    return cut_lineage(kept.select(*keys, "_f", "_v", "run_n", "all_n", "all_m", "all_d").groupBy(*keys).applyInArrow(gather, schema))


def _summed(distinct: DataFrame, bounds: DataFrame, keys: list[str], features: list[str], targets: list[str]) -> DataFrame:
    """Cells: rows and sums of targets per key and bin numbers (``_codes``, two bytes a feature)."""
    given = [*keys, "_codes", "_rows", *targets]
    schema = T.StructType([distinct.schema[k] for k in keys] + [T.StructField("_codes", T.BinaryType()), T.StructField("_rows", T.DoubleType())] + [T.StructField(t, T.DoubleType()) for t in targets])

    def sum_part(group, found):
        if not group.num_rows or not found.num_rows:
            return pa.Table.from_arrays([pa.array([], group.schema.field(k).type) for k in keys] + [pa.array([], pa.binary())] + [pa.array([], pa.float64())] * (1 + len(targets)), names=given)
        medians, edges = found["medians"][0].as_py(), found["edges"][0].as_py()
        columns = []
        for f, median, cuts in zip(features, medians, edges):
            v = group[f].to_numpy().astype(float)
            columns.append(np.searchsorted(np.array(cuts, float), np.where(np.isnan(v), median, v), side="left"))
        codes = np.stack(columns, axis=1)
        first, which = _alike(codes)
        packed = pa.Array.from_buffers(pa.binary(2 * len(features)), len(first), [None, pa.py_buffer(codes[first].astype("<u2").tobytes())]).cast(pa.binary())
        sums = [pa.array(np.bincount(which, group[c].to_numpy().astype(float), len(first))) for c in ("_rows", *targets)]
        return pa.Table.from_arrays([group[k].take(pa.array(first)) for k in keys] + [packed] + sums, names=given)

    parts = _met(distinct, keys, bounds, ["medians", "edges"]).applyInArrow(sum_part, schema)
    return parts.groupBy(*keys, "_codes").agg(*[F.sum(c).alias(c) for c in ("_rows", *targets)])


def fit_models(rows: DataFrame, keys: Sequence[str], settings: Sequence[TreeSettings] | Mapping[int, TreeSettings] = (TreeSettings(),), x: str = "x",
               y: str | Sequence[str] = "y", fit_rows: int = FIT_ROWS, width: int | None = None) -> DataFrame:
    """One row per key with its model, fitted on all of the key's rows.

    ``x``: an array of ``width`` features (by default as many as in the first row). With several targets ``y`` every one has its model, and ``slot`` (bigint, its
    place in the list) is one more key. With several settings, ``setting`` (their index) is one of the keys; if rows do not have it, every
    key is fitted under all settings and ``setting`` is one more key. ``fit_rows``: cells that a task reads at once.
    """
    keys, several = list(keys), not isinstance(y, str)
    chosen = dict(settings if isinstance(settings, Mapping) else enumerate(settings))
    own = isinstance(settings, Mapping) or len(chosen) > 1
    widths = sorted({s.bins for s in chosen.values()})
    if len(widths) > 1:
        groups = [{i: s for i, s in chosen.items() if s.bins == w} for w in widths]
        each = [rows.filter(F.col("setting").isin(list(g))) if "setting" in keys else rows for g in groups]
        return reduce(DataFrame.unionByName, [fit_models(d, keys, g, x, y, fit_rows, width) for d, g in zip(each, groups)])
    if width is None:
        row = rows.select(F.size(x)).first()
        width = row[0] if row else 1
    features, targets = [f"_x{i}" for i in range(width)], [f"_y{i}" for i in range(len(y) if several else 1)]
    plain = rows.select(
        *keys,
        *[F.nanvl(F.col(x)[i].cast("double"), F.lit(None).cast("double")).alias(f) for i, f in enumerate(features)],
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(t) for c, t in zip(y if several else [y], targets)],
    )
    distinct = cut_lineage(plain.groupBy(*keys, *features).agg(F.count("*").alias("_rows"), *[F.sum(t).alias(t) for t in targets]))
    bounds = _bounds(distinct, keys, features, widths[0])
    cells = _summed(distinct, bounds, keys, features, targets)
    by = list(keys)
    if several:
        cells = cells.select(*keys, "_codes", "_rows", F.posexplode(F.array(*targets)).alias("slot", "_y0")).withColumn("slot", F.col("slot").cast("bigint"))
        by.append("slot")
    if own and "setting" not in keys:
        cells = cells.withColumn("setting", F.explode(F.array(*[F.lit(i) for i in chosen])))
        by.append("setting")
    which = by.index("setting") if own else None
    kinds, grown = [cells.schema[k] for k in by], {n: k for n, k in _SPARK.items() if n != "medians"}
    schema = T.StructType(kinds + [T.StructField(n, k) for n, k in grown.items()])
    packed = np.dtype("<u2")

    def train(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as a, tempfile.TemporaryFile() as b, tempfile.TemporaryFile() as c:
            rows = 0
            for batch in batches:
                rows += batch.num_rows
                a.write(b"".join(batch["_codes"].to_pylist()))
                b.write(batch["_rows"].to_numpy().astype(float).tobytes())
                c.write(batch["_y0"].to_numpy().astype(float).tobytes())
                types = [batch.schema.field(n).type for n in by]
            for f in (a, b, c):
                f.flush()
            shapes = ((a, packed, (rows, len(features))), (b, float, rows), (c, float, rows))
            held = [np.asarray(np.memmap(f, kind, "r+", shape=shape)) for f, kind, shape in shapes]
            found = grow(*held, chosen[key[which].as_py() if which is not None else 0], fit_rows)
        columns = [pa.array([k.as_py()], t) for k, t in zip(key, types)]
        lists = [pa.array([found[n].tolist()], pa.list_(MODEL_PARTS[n])) for n in grown]
        yield pa.RecordBatch.from_arrays(columns + lists, names=schema.names)

    # Cells are few bytes for the work they make, so their partitions must not be put together by size.
    apart = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    models = cells.select(*by, "_codes", "_rows", "_y0").repartition(apart, *by).groupBy(*by).applyInArrow(train, schema)
    value = F.zip_with("feature", "threshold", lambda f, b: F.when(f >= 0, F.get(F.get("edges", f), b.cast("int"))).otherwise(0.0))
    return models.join(bounds, keys).withColumn("threshold", value).select(*by, *MODEL_PARTS)


def predict_models(models: DataFrame, rows: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """Rows of every key that has a model, with ``name`` in place of ``x``."""
    kept = [c for c in rows.columns if c != x]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())])

    def apply(group, given):
        if not group.num_rows or not given.num_rows:
            return pa.Table.from_arrays([pa.array([], group.schema.field(c).type) for c in kept] + [pa.array([], pa.float64())], names=schema.names)
        model = {n: given[n].combine_chunks()[0].values.to_numpy(zero_copy_only=False) for n in MODEL_PARTS}
        return group.select(kept).append_column(name, pa.array(predict(model, feature_matrix(group[x]))))

    return _met(rows, keys, models, list(MODEL_PARTS)).applyInArrow(apply, schema)
