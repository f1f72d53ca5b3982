"""Column expressions on numbers and on numeric arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; inside a lambda it would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Division with 0 for a zero denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, value: acc + value)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, value: acc + value * value))


def l2_normalize(vector: Column, eps: float = 1e-12) -> Column:
    """Unit-length copy of a vector; the length is floored at ``eps``."""
    length = F.greatest(l2_norm(vector), F.lit(eps))
    return bind(length, lambda norm: F.transform(as_doubles(vector), lambda value: value / norm))


def standardize(vector: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(as_doubles(vector), mean, lambda value, m: value - m)
    return F.zip_with(centred, std, lambda value, s: value / s)


def neighbour_count(n: Column) -> Column:
    """Neighbours per row for the embedding: between 10 and 50, a tenth of the root of the size."""
    tenth = F.floor(F.sqrt(n.cast("double")) / 10)
    return F.least(F.lit(50), F.greatest(F.lit(10), tenth)).cast("int")
