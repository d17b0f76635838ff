"""Vector expressions on array columns (no Python workers)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.text import let


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(a)
    return let(F.when(length == 0, F.lit(1.0)).otherwise(length), lambda n: F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing or zero vectors."""
    scaled = let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))
    return F.coalesce(scaled, F.lit(0.0))


def mean_vector(v: Column) -> Column:
    """Element-wise mean as an aggregate with map-side combine."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))
