"""Hexagonal axial binning and great-circle distance.

The grid is a plain axial hexagon grid on projected coordinates. It is not
compatible with any published global hexagon index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT3 = math.sqrt(3.0)
# The six axial neighbours of a hexagon.
RING = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
EARTH_RADIUS_KM = 6371.0088


def axial_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon that holds a point: cube rounding in SQL arithmetic."""
    fq = (F.lit(SQRT3 / 3.0) * x - F.lit(1.0 / 3.0) * y) / F.lit(size)
    fr = (F.lit(2.0 / 3.0) * y) / F.lit(size)
    fs = -fq - fr
    rq, rr, rs = (F.floor(c + F.lit(0.5)) for c in (fq, fr, fs))
    dq, dr, ds = F.abs(rq - fq), F.abs(rr - fr), F.abs(rs - fs)
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q.cast("bigint"), r.cast("bigint")


def cell_id(q: Column, r: Column) -> Column:
    return F.concat(q.cast("string"), F.lit(":"), r.cast("string"))


def cell_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    x = F.lit(size) * (F.lit(SQRT3) * q + F.lit(SQRT3 / 2.0) * r)
    return x, F.lit(size) * (F.lit(1.5) * r)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2.0
    half_lon = F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) ** 2
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
