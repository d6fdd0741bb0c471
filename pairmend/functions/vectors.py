"""Column functions on embedding vectors; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the quotient defined for a zero vector.
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is; 0 if one is all zeros; nulls too for what isn't a number."""
    value = dot(a, b) / (norm(a) * norm(b) + F.lit(TINY))
    return F.when(~F.isnan(value), value)


def normalize(a: Column) -> Column:
    """At length 1; a zero vector stays zero."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / (n + F.lit(TINY))))[0]


def fit(a: Column, size: int) -> Column:
    """Exactly `size` floats: cut, or padded with zeros; all zeros for null."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return F.slice(F.concat(F.coalesce(a.cast("array<float>"), F.array().cast("array<float>")), zeros), 1, size)
