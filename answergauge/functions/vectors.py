"""Vectors as arrays, and the small functions around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The vector of length 1; a zero vector stays as it is."""
    n = l2_norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 for a zero vector, and never below 0."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, clamp01(dot(a, b) / n)).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def numbers_equal(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Equal, or apart by no more than a share of the larger; near zero, by less than 1e-9. NaN equals nothing."""
    d, m = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    near = F.when(m < 1e-9, d < 1e-9).otherwise(d <= F.lit(tolerance) * m)
    return F.when(F.isnan(d), F.lit(False)).otherwise((d == 0) | near)


def is_integer(v: Column) -> Column:
    return v == F.rint(v)


def is_year(v: Column) -> Column:
    return is_integer(v) & v.between(1900, 2100)
