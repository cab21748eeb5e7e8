"""Column functions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_score(cosine_value: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) + cosine_value) / 2))


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))
