"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """One minus cosine similarity; null when either side has no direction."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, F.lit(1.0) - dot(a, b) / scale)


def has_width(a, dim: int) -> Column:
    return F.coalesce(F.size(a) == dim, F.lit(False))


def constant_vector(value: float, dim: int) -> Column:
    return F.array_repeat(F.lit(value).cast("float"), dim)
