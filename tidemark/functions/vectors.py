"""Vector expressions over array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """L2-normalised array; `eps` keeps the zero vector finite.

    The length is spread to an array first: inside a lambda it would be computed for every element.
    """
    length = F.array_repeat(norm(a) + F.lit(eps), F.size(a))
    return F.zip_with(a, length, lambda x, n: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def one_hot(value: Column, categories: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in categories]),
                       lambda c: F.when(c == value, F.lit(1.0)).otherwise(F.lit(0.0)))


def linear_score(features: dict[str, float], intercept: float = 0.0) -> Column:
    """Sum of literal weights times columns, null features counting as zero."""
    out = F.lit(float(intercept))
    for name, weight in features.items():
        out = out + F.lit(float(weight)) * F.coalesce(F.col(name), F.lit(0.0))
    return out
