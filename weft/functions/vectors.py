"""Vector operators on array<double> columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip_sum(a: Column, b: Column, each) -> Column:  # noqa: ANN001
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _zip_sum(a, b, lambda x, y: x * y)


def l1(a: Column, b: Column) -> Column:
    return _zip_sum(a, b, lambda x, y: F.abs(x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_zip_sum(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def hadamard(a: Column, b: Column, k: int = 8) -> Column:
    """The first k products of components."""
    return F.slice(F.zip_with(a, b, lambda x, y: x * y), 1, k)


def or_zero(a: Column, dim: int) -> Column:
    """The vector, or zeros for a missing one."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0), dim))
