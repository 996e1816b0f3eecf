"""Functions of columns that hold dense vectors (arrays of numbers); all arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Name) -> Column:
    return col(v).cast("array<double>")


def total(v: Name) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Name, b: Name) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v: Name) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Name) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(col(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def added(a: Name, b: Name) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def scaled(v: Name, by: Name) -> Column:
    return F.transform(col(v), lambda x: x * col(by))


def cosine(a: Name, b: Name) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sqdist(a: Name, b: Name) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pdist(a: Name, b: Name, p: float) -> Column:
    return F.pow(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def requantized(v: Name, digits: int) -> Column:
    return F.transform(col(v), lambda x: F.round(x, digits))


def bin_index(score: Name, low: float, high: float, bins: int) -> Column:
    """floor((s - low) * bins / (high - low)), held between 0 and bins - 1."""
    at = F.floor((col(score) - F.lit(float(low))) * F.lit(float(bins)) / F.lit(float(high - low)))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("long")


def clipped(x: Name, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(x)))


def rounded(x: Name, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def argmax(v: Name, first: int, count: int) -> Column:
    """Position (from 0) of the first greatest of `count` components from `first` (from 1) on."""
    part = F.slice(col(v), first, count)
    return (F.array_position(part, F.array_max(part)) - 1).cast("long")
