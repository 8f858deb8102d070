"""Vector arithmetic on arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null if a side is null or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def parsed(text: Column) -> Column:
    """The text form [v1,v2,...]."""
    return F.from_json(text, "array<float>")
