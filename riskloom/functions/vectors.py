"""Vectors as arrays of double, inside the JVM; the dimension is the array's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def scaled(a: Column, eps: float = 1e-12) -> Column:
    """a divided by its length."""
    size = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x / size)


def array_mean(vec: str, weight: str | None = None) -> Column:
    """Aggregate: the (weighted) mean vector, from partial sums on the map side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(vec))
    return vector_to_array(Summarizer.mean(v, F.col(weight).cast("double")) if weight else Summarizer.mean(v))
