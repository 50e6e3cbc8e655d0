"""Vectors as arrays of numbers; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x * by)


def unit(v: Column) -> Column:
    """``v`` at length 1; a vector of length 0 raises."""
    length = F.when(norm(v) > 0, norm(v)).otherwise(F.raise_error(F.lit("a vector has norm 0")).cast("double"))
    return F.transform(as_doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def has_inf(v: Column) -> Column:
    return F.exists(as_doubles(v), lambda x: (x == float("inf")) | (x == float("-inf")))


def describe(id_: Column, v: Column) -> Column:
    """A record of a vector: id, values, dimension and norm."""
    return F.struct(id_.alias("id"), v.alias("embedding"), F.size(v).alias("dim"), norm(v).alias("norm"))
