"""Vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; 1e-9 keeps an all-zero vector finite."""
    return F.transform(_doubles(a), lambda x: x / (norm(a) + F.lit(1e-9)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(1e-9)) * (norm(b) + F.lit(1e-9)))
