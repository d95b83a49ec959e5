"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when one vector is zero."""
    sizes = norm(a) * norm(b)
    return F.when(sizes == 0, 0.0).otherwise(dot(a, b) / sizes)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
