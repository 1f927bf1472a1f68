"""Vector expressions on array columns; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column) -> Column:
    """A unit vector; one of almost no length becomes zeros."""
    # the length is bound by the outer function, or it would be summed anew for each number
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n < 1e-10, 0.0).otherwise(x.cast("double") / n))), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors."""
    return 1 - dot(a, b)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def fit_length(a: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)
