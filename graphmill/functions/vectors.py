"""Column functions over vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Each component over the norm, which counts as 1e-12 at least."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def fitted(a: Column, dim: int) -> Column:
    """The first dim components, zeros appended if there are fewer."""
    values = F.transform(a, lambda x: x.cast("double"))
    return F.concat(F.slice(values, 1, dim), F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(a), F.lit(0))))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
