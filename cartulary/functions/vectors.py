"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where the product of the lengths is 1e-9 or less."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-9, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def is_vector(v: Column, dims: int) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull())
