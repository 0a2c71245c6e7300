"""Cell x year x category panels: grids, lags, neighbours, shares, folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions import geo
from tallyveil.functions.geo import EARTH_RADIUS_KM
from tallyveil.functions.hashing import SPAN, mixed_hash, mixed_hashes, uniform
from tallyveil.operators.metric_tree import nearest
from tallyveil.operators.ordering import positions


# ---- grids --------------------------------------------------------------------------

def dense_panel(units: DataFrame, years: Sequence[int], categories: Sequence[str]) -> DataFrame:
    """J-08 / S-01: every unit in every listed year and category.

    The lists are literals exploded on each row, so the grid needs no shuffle and no join.
    """
    out = units
    for name, values in (("year", years), ("category", categories)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def zero_filled(panel: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """J-04: left join with missing counts as zero."""
    picked = counts.select(*keys, F.col(value).cast("double").alias(name))
    return panel.join(picked, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def lagged(panel: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, name: str, years: int = 1) -> DataFrame:
    """J-05: value of the same unit ``years`` earlier; a gap in the data gives zero, not the
    value of an older year, which is why this is a join and not ``lag``."""
    return zero_filled(panel, counts.withColumn("year", F.col("year") + years), keys, value, name)


def lag_features(panel: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, lags: Mapping[str, int]) -> DataFrame:
    """J-04 and J-05 together: several lags (0 is the target itself) with one join.

    Counts are spread to the years they serve and gathered per key, so the panel is shuffled
    once instead of once per lag.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("by")) for n, k in lags.items()])).alias("_l")
    spread = counts.select(*keys, F.col(value).cast("double").alias("_v"), shifts).withColumn("year", F.col("year") + F.col("_l.by"))
    wide = spread.groupBy(*keys).agg(*[F.sum(F.when(F.col("_l.name") == n, F.col("_v"))).alias(n) for n in lags])
    return panel.join(wide, list(keys), "left").fillna(0.0, list(lags))


def dense_lags(units: DataFrame, counts: DataFrame, years: Sequence[int], categories: Sequence[str], value: str, lags: Mapping[str, int],
               unit: str = "cell", widest: int = 300) -> DataFrame:
    """J-08, J-04 and J-05 together: the dense panel of the units with several lags (0 is the target itself).

    Counts are summed into one row per unit, with a column for each year and category that the panel looks at. Units meet
    that row before they are spread over years and categories, so grid rows are neither shuffled nor sorted. ``counts`` may
    hold several rows per key. Grids of more than ``widest`` columns take the join of ``lag_features``.
    """
    spots = list(dict.fromkeys((y - k, c) for y in years for k in lags.values() for c in categories))
    if not lags or not 0 < len(spots) <= widest:
        return lag_features(dense_panel(units, years, categories), counts, [unit, "year", "category"], value, lags)
    number = {spot: i for i, spot in enumerate(spots)}
    seen = counts.filter(F.col("year").isin(sorted({y for y, _ in spots})) & F.col("category").isin(list(categories)))
    spot = F.coalesce(*[F.when((F.col("year") == y) & (F.col("category") == c), i) for (y, c), i in number.items()])
    # Counts go to their unit's task before they are summed: sums before the shuffle would hold a wide row for every unit of a file's part.
    placed = seen.select(unit, spot.alias("_spot"), F.col(value).cast("double").alias("_v")).repartition(unit)
    wide = placed.groupBy(unit).agg(*[F.sum(F.when(F.col("_spot") == i, F.col("_v"))).alias(f"_s{i}") for i in number.values()])

    def found(y: int, c: str) -> Column:
        return F.coalesce(F.nanvl(f"_s{number[y, c]}", F.lit(None).cast("double")), F.lit(0.0))

    rows = [F.struct(F.lit(y).alias("year"), F.lit(c).alias("category"), *[found(y - k, c).alias(n) for n, k in lags.items()]) for y in years for c in categories]
    rest = [F.col(n) for n in units.columns if n != unit]
    return units.join(wide, unit, "left").select(unit, *rest, F.inline(F.array(*rows))).select(unit, "year", "category", *rest, *lags)


def neighbour_mean(panel: DataFrame, edges: DataFrame, value: str, name: str, by: Sequence[str] = ("year", "category"),
                   cell: str = "cell") -> DataFrame:
    """J-06: mean over existing neighbours (cell degree is at most six)."""
    around = edges.join(panel.select(F.col(cell).alias("dst"), *by, value), "dst")
    ring = around.groupBy(F.col("src").alias(cell), *by).agg(F.avg(value).alias(name))
    return panel.join(ring, [cell, *by], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def share_in_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """W-01: share of the group sum, zero when the sum is zero. Sums are pre-aggregated and
    joined back, so no group has to fit into one task."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(0.0)
    return df.join(totals, list(keys)).withColumn(name, share).drop("_total")


def merge_surfaces(surface: DataFrame, oracle: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """J-07: full outer join; the surface's district wins, missing numbers count as zero."""
    keys = list(keys)
    left = surface.withColumnRenamed("district", "_ds")
    joined = left.join(oracle.withColumnRenamed("district", "_do"), keys, "full_outer")
    out = joined.withColumn("district", F.coalesce("_ds", "_do")).drop("_ds", "_do")
    return out.withColumns({v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values})


def dominant_label(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """W-04: label with the largest sum per key; on ties the larger label."""
    sums = df.groupBy(key, label).agg(F.sum(value).alias("_s"))
    return sums.groupBy(key).agg(F.max_by(F.col(label), F.struct("_s", label)).alias(label))


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """S-02 / S-03: the first row of each key in an explicit order, as an aggregation."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def with_known_district(df: DataFrame, fallback: str, district: str = "district", population: str = "population") -> DataFrame:
    """P-09: keep units with a district or people; the rest of the districts get a fallback label."""
    kept = df.filter(F.col(district).isNotNull() | (F.coalesce(F.col(population), F.lit(0.0)) > 0))
    return kept.withColumn(district, F.coalesce(F.col(district), F.lit(fallback)))


def city_panel(points: DataFrame, units: DataFrame, years: Sequence[int], categories: Sequence[str], fallback: str) -> DataFrame:
    """ML-21: grid x years x categories with dominant district, target and persistence."""
    district = dominant_label(points, "cell", "district", "count")
    # A border cell has several districts; its counts are summed per cell.
    full = dense_lags(units.drop("district").join(district, "cell", "left"), points, years, categories, "count", {"target": 0, "persist": 1})
    return with_known_district(full, fallback)


# ---- points and cells ---------------------------------------------------------------

def points_to_cells(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """F-25: unreadable or outside coordinates are dropped, the rest gets a hexagon."""
    px, py = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    west, south, east, north = box
    inside = px.between(west, east) & py.between(south, north)
    kept = points.withColumns({"_x": px, "_y": py}).filter(inside)
    q, r = geo.axial_cell(F.col("_x"), F.col("_y"), size)
    return kept.withColumns({"q": q, "r": r}).withColumn("cell", geo.cell_id(F.col("q"), F.col("r"))).drop("_x", "_y")


def point_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M-35."""
    return points.groupBy(*keys).agg(F.count("*").alias("count"))


def pixel_density(pixels: DataFrame, value: str, size: float) -> DataFrame:
    """M-36: pixel values summed per cell and divided by the hexagon area."""
    area = 1.5 * geo.SQRT3 * size * size
    sums = pixels.groupBy("cell").agg(F.sum(value).alias("total"))
    return sums.withColumn("density", F.col("total") / F.lit(area))


def fill_box(cells: DataFrame) -> DataFrame:
    """F-26: all axial cells of the bounding box of the given cells.

    The box is one row; its first axis is exploded and spread before the second axis is.
    """
    box = cells.agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    columns = box.select(F.explode(F.sequence("q0", "q1")).alias("q"), "r0", "r1").repartition("q")
    return columns.select("q", F.explode(F.sequence("r0", "r1")).alias("r")).withColumn("cell", geo.cell_id(F.col("q"), F.col("r")))


def ring_edges(cells: DataFrame) -> DataFrame:
    """F-27: directed edges to the six neighbours that exist."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in geo.RING])
    spread = cells.select("cell", "q", "r", F.explode(offsets).alias("o"))
    edges = spread.select(F.col("cell").alias("src"), geo.cell_id(F.col("q") + F.col("o.dq"), F.col("r") + F.col("o.dr")).alias("dst"))
    return edges.join(cells.select(F.col("cell").alias("dst")), "dst", "left_semi")


def blocks_for(df: DataFrame, size: int) -> int:
    """Number of blocks of about ``size`` rows (one counting job)."""
    return max(1, -(-df.count() // size))


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Great-circle distances of every first to every second point (radians in, km out)."""
    h = np.sin((lat2 - lat1[:, None]) / 2) ** 2 + np.cos(lat1[:, None]) * np.cos(lat2) * np.sin((lon2 - lon1[:, None]) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _on_sphere(points: DataFrame, key: Column, cell: Column, asks: bool) -> DataFrame:
    """Places as unit vectors, with their coordinates carried along."""
    lat, lon = F.radians("lat"), F.radians("lon")
    vec = F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return points.select(key.alias("key"), vec.alias("vec"), F.lit(not asks).alias("target"), F.lit(asks).alias("query"), cell.alias("cell"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def nearest_distance(cells: DataFrame, facilities: DataFrame, block: int = 2048) -> DataFrame:
    """F-28: great-circle distance to the nearest facility: (cell, km), one row per cell with coordinates.

    Both sides lie in the same tree of pivots (``metric_tree``): a cell searches the sites of its own leaf, and then the leaves that can
    hold a nearer one. A leaf of sites is shipped only to leaves of cells that visit it; each visit returns one row per cell.
    ``cells``: cell, lat, lon; ``facilities``: lat, lon. Without facilities every distance is null.
    """
    kind = dict(cells.dtypes)["cell"]
    here, there = (d.filter("lat IS NOT NULL AND lon IS NOT NULL").select(*c).distinct() for d, c in ((cells, ("cell", "lat", "lon")), (facilities, ("lat", "lon"))))
    if not there.limit(1).count():
        return cells.select("cell", F.lit(None).cast("double").alias("km")).distinct()
    asking = _on_sphere(here, F.to_json(F.struct("cell", "lat", "lon")), F.col("cell"), True)
    points = asking.unionByName(_on_sphere(there, F.to_json(F.struct("lat", "lon")), F.lit(None).cast(kind), False))

    def search(q: np.ndarray, t: np.ndarray, limit: np.ndarray, asked: pa.StructArray, held: pa.StructArray) -> dict[str, pa.Array]:
        la, lo, lb, ob = (np.radians(np.asarray(side.field(c), float)) for side in (asked, held) for c in ("lat", "lon"))
        best = [_km(la[s : s + 512], lo[s : s + 512], lb, ob).min(axis=1) for s in range(0, len(la), 512)]
        return {"key": asked.field("key"), "cell": asked.field("cell"), "km": pa.array(np.concatenate(best))}

    def limits(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg((F.min("km") / geo.EARTH_RADIUS_KM).alias("found"))

    found = nearest(points, search, f"key string, cell {kind}, km double", limits, block=block, start=F.lit(math.pi), carry=["cell", "lat", "lon"])
    return found.groupBy("cell").agg(F.min("km").alias("km"))


def district_adjacency(edges: DataFrame, districts: DataFrame) -> DataFrame:
    """J-18: pairs of different districts that share a cell edge, both directions."""
    a = districts.select(F.col("cell").alias("src"), F.col("district").alias("a"))
    b = districts.select(F.col("cell").alias("dst"), F.col("district").alias("b"))
    pairs = edges.join(a, "src").join(b, "dst").filter(F.col("a") != F.col("b"))
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select("p.a", "p.b").distinct()


# ---- folds and thinning -------------------------------------------------------------

def hold_out(df: DataFrame, train_years: Sequence[int], test_year: int) -> DataFrame:
    """ML-07: mark rows as train or test; other years are dropped."""
    part = F.when(F.col("year").isin(list(train_years)), "train").when(F.col("year") == test_year, "test")
    return df.withColumn("part", part).filter("part IS NOT NULL")


def seeded_folds(units: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """ML-08 / ML-09: contiguous, equally sized folds of the units in seeded hash order."""
    u = units.select(key).distinct().withColumn("_h", mixed_hash(F.col(key), seed))
    placed = positions(u, [], [F.col("_h"), F.col(key)])
    # The first n mod k folds take one unit more, as an equal split does.
    n, i = F.col("group_rows"), F.col("position") - 1
    big, small = F.ceil(n / folds).cast("bigint"), F.floor(n / folds).cast("bigint")
    head = (n % folds) * big
    fold = F.when(i < head, F.floor(i / big)).otherwise(n % folds + F.floor((i - head) / F.greatest(small, F.lit(1))))
    return placed.select(key, fold.cast("bigint").alias("fold"))


def membership(units: DataFrame, folds: DataFrame, key: str, count: int) -> DataFrame:
    """S-04: each unit as test in its own fold and train in every other fold."""
    spread = units.join(folds.withColumnRenamed("fold", "_own"), key).withColumn(
        "fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    )
    return spread.withColumn("part", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")).drop("_own")


def buffered_membership(members: DataFrame, adjacency: DataFrame, district: str = "district") -> DataFrame:
    """ML-10: train rows of districts next to a test district are removed."""
    tested = members.filter("part = 'test'").select("fold", F.col(district).alias("b")).distinct()
    near = adjacency.join(tested, "b").select("fold", F.col("a").alias(district), F.lit("train").alias("part")).distinct()
    return members.join(near, ["fold", district, "part"], "left_anti")


def district_hold_out(units: DataFrame, key: str, seed: int, share: float = 0.25) -> DataFrame:
    """ML-12: about a quarter of the districts, at least one, become the test set."""
    u = units.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_h", mixed_hash(F.col(key), seed))
    placed = positions(u, [], [F.col("_h"), F.col(key)])
    size = F.greatest(F.lit(1), F.floor(F.col("group_rows") * F.lit(share))).cast("bigint")
    return placed.select(key, F.when(F.col("position") <= size, "test").otherwise("train").alias("part"))


def thinned_count(key: Column, value: str, rate: float, base: float, seed: int, chunk: int = 10_000) -> Column:
    """ML-17: how many of a row's counted events are kept with probability min(1, rate / base).

    Each event draws from its row's key and its own number, so the result does not depend on
    partitioning. The events of a row are drawn ``chunk`` at a time inside one expression:
    rows of any size take the same way, and repeated rows stay apart.
    """
    p, draw_seed = _drawing(rate, base, seed)
    if p >= 1.0:
        return F.col(value)
    n = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    none = F.lit(0).cast("bigint")

    def kept(c: Column) -> Column:
        events = F.sequence(c * chunk + 1, F.least((c + 1) * chunk, n))
        return F.size(F.filter(events, lambda i: uniform(key, draw_seed, i) < F.lit(p))).cast("bigint")

    chunks = F.sequence(none, F.floor((n - 1) / chunk).cast("bigint"))
    drawn = F.aggregate(chunks, none, lambda total, c: total + kept(c))
    return F.when(n > 0, drawn).otherwise(none).cast("double")


#: Events drawn at once.
DRAWN = 65_536


def _drawing(rate: float, base: float, seed: int) -> tuple[float, int]:
    return min(1.0, rate / base), 1000 * seed + int(round(100 * rate))


def thin_draws(keys: pa.Array, values: np.ndarray, draws: Sequence[tuple[float, float, int]]) -> list[np.ndarray]:
    """``thinned_count`` of a task's rows for several (rate, base, seed): one array each.

    The same draws, hashed for many events at a time; ``DRAWN`` events are held, whatever a row counts.
    """
    made = [_drawing(*d) for d in draws]
    out = [values if p >= 1.0 else np.zeros(len(values)) for p, _ in made]
    some = [(o, p * SPAN, f"{seed}") for o, (p, seed) in zip(out, made) if p < 1.0]
    events = np.maximum(np.nan_to_num(values, nan=0.0), 0.0).astype(np.int64)
    ends = np.cumsum(events)
    texts = pc.fill_null(pc.cast(keys, pa.string()), "")
    for s in range(0, int(ends[-1]) if len(ends) and some else 0, DRAWN):
        event = np.arange(s, min(s + DRAWN, int(ends[-1])))
        row = np.searchsorted(ends, event, side="right")
        number = pa.array(event - (ends[row] - events[row]) + 1).cast(pa.string())
        drawn = mixed_hashes(pc.binary_join_element_wise(texts.take(pa.array(row)), number, "", "|"), [seed for _, _, seed in some])
        first, last = int(row[0]), int(row[-1]) + 1
        for (o, below, _), h in zip(some, drawn):
            o[first:last] += np.bincount(row[h < below] - first, minlength=last - first)
    return out


def thinned_counts(df: DataFrame, key: Column, value: str, name: str, draws: Sequence[tuple[float, float, int]]) -> DataFrame:
    """ML-17 for several (rate, base, seed) at once: ``thinned_count`` of each as an array."""
    rows = df.withColumn("_key", key.cast("string"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    whole = np.array([_drawing(*d)[0] >= 1.0 for d in draws])

    def draw(batches):
        for b in batches:
            # Where all events are kept, a count that is missing stays so.
            unknown = np.outer(b[value].is_null().to_numpy(zero_copy_only=False), whole).ravel()
            found = thin_draws(b["_key"], b[value].to_numpy(zero_copy_only=False).astype(float), draws)
            flat = np.stack(found, axis=1).ravel() if found else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(found)), pa.array(flat, mask=unknown))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in schema.names[:-1]], lists], names=schema.names)

    return rows.mapInArrow(draw, schema)


def thin_counts(df: DataFrame, key: Column, value: str, name: str, rate: float, base: float, seed: int, chunk: int = 10_000) -> DataFrame:
    """ML-17: ``thinned_count`` as a column."""
    return df.withColumn(name, thinned_count(key, value, rate, base, seed, chunk))


def fold_summary(scores: DataFrame, values: Sequence[str]) -> DataFrame:
    """M-31: fold count, mean and population deviation per split."""
    columns = [F.count("*").alias("folds")]
    for v in values:
        columns += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_sd")]
    return scores.groupBy("split").agg(*columns)


def coordinate_rate(points: DataFrame, province: str, has_point: str) -> DataFrame:
    """M-32: share of records with coordinates per province, largest volume first."""
    return points.groupBy(province).agg(F.count("*").alias("records"), F.avg(F.col(has_point).cast("double")).alias("rate")).orderBy(
        F.desc("records"), province
    )


# ---- reshaping ----------------------------------------------------------------------

def long_predictions(wide: DataFrame, keys: Sequence[str], categories: Sequence[str], prefix: str = "pred_") -> DataFrame:
    """IO-15: one row per category; columns that are absent are skipped."""
    present = [c for c in categories if f"{prefix}{c}" in wide.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{prefix}{c}").alias("pred")) for c in present])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.category", "_p.pred")


def wide_targets(long: DataFrame, keys: Sequence[str], categories: Sequence[str], value: str) -> DataFrame:
    """IO-16: one summed column per listed category."""
    return long.groupBy(*keys).pivot("category", list(categories)).agg(F.sum(value))


def replace_targets(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """IO-17: target columns taken from another surface."""
    return df.drop(*columns).join(other.select(*keys, *columns), list(keys), "left")


def for_test_year(predictions: DataFrame, year: int) -> DataFrame:
    """P-08: a table without a year column is taken as the test year."""
    if "year" not in predictions.columns:
        return predictions.withColumn("year", F.lit(year))
    return predictions.filter(F.coalesce(F.col("year"), F.lit(year)) == year)


def mean_predictions(predictions: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """ML-06, first part: several predictions of one key are averaged."""
    return predictions.groupBy(*keys).agg(F.avg("pred").alias(name))
