"""Vectors as arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """a with length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))
