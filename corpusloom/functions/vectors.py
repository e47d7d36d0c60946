"""Vector and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def exclusive_quantile(sorted_values: Column, q: float) -> Column:
    """Position q(n+1) of an ascending array, interpolated, ends clamped to the first or last gap; null under two values."""
    n = F.size(sorted_values)
    h = F.lit(q) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(h).cast("int"), n - 1))
    at = lambda i: F.try_element_at(sorted_values, i)
    return F.when(n >= 2, at(j) + (h - j) * (at(j + 1) - at(j)))
