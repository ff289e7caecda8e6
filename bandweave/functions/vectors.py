"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x))


def normalised(a: Column) -> Column:
    """a divided by its length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of vectors; the shorter one is filled with zeros."""
    gap = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return norm(gap)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors; null if either is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def argmax(a: Column) -> Column:
    """The place of the largest element, from 0; the lowest on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
