"""Vectors as arrays: products, pooling, and the choice of the nearest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def pooled(vectors: Column, mask: Column | None = None) -> Column:
    """The mean of an array of vectors, or of those that ``mask`` (an array of 0 and 1) keeps; null if there is none."""
    kept = vectors if mask is None else F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    doubles = F.transform(kept, lambda v: F.transform(v, lambda x: x.cast("double")))
    zeros = F.transform(F.get(doubles, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(doubles, zeros, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def rounded(x: Column, places: int) -> Column:
    """As DuckDB rounds: the halves of ``x`` times a power of ten away from zero, and what is negative keeps its sign, so a small one becomes -0.0."""
    size = F.round(F.abs(x) * 10.0**places) / 10.0**places
    return F.when(x < 0, -size).otherwise(size)


def first_best(value: Column, score: Column, order: Column) -> Column:
    """An aggregate: the value of the greatest score, the least ``order`` on ties."""
    return F.min_by(value, F.struct(-score, order))
