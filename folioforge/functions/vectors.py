"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; null where the norm is zero or not finite."""
    return bind(norm(a), lambda n: F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: x / n)))  # the norm once, not for each component


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length or without a direction."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))
