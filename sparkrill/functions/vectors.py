"""Vector functions on arrays, as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is a zero vector, an error if their lengths differ."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors of different lengths").isNull()
    length = norm(a) * norm(b)
    return F.when(same & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))
