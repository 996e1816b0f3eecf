"""Vectors pooled by key: component by component, so that partial sums meet before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized


def pooled(rows: DataFrame, keys: list[str], vector: str = "v", op: str = "mean", out: str = "v") -> DataFrame:
    """(keys, out, n): the sum or mean of the vectors of each key. Components are summed in the JVM, map side first."""
    agg = {"sum": F.sum, "mean": F.avg}[op]
    long = rows.select(*keys, F.posexplode(vector).alias("d", "x"))
    each = long.groupBy(*keys, "d").agg(agg("x").alias("x"), F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(out), F.max("n").alias("n"))


def templates(rows: DataFrame, template: str = "template", media: str = "media", vector: str = "v") -> DataFrame:
    """(template, v): the unit vector of the sum over media of the mean of their vectors."""
    means = pooled(rows, [template, media], vector, "mean")
    return pooled(means, [template], "v", "sum").select(template, normalized("v").alias("v"))
