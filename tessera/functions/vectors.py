"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty or zero vectors and unequal lengths."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n), F.lit(0.0))


def normalised(a: Column, length: int | None = None) -> Column:
    """Unit vector, cut or padded with zeros to ``length``; a zero vector stays zero."""
    doubles = a.cast("array<double>")
    fitted = doubles if length is None else F.slice(F.concat(doubles, F.array_repeat(F.lit(0.0), length)), 1, length)
    n = norm(fitted)
    return F.when(n > 0, F.transform(fitted, lambda x: x / n)).otherwise(fitted)
