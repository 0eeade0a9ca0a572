"""Vector expressions in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, never below 0; null for null or zero vectors."""
    distance = 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(distance < 0, 0.0).otherwise(distance)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
