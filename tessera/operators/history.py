"""Run histories: metrics by step, with nulls, merged and monitored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def by_prefix(columns: list[str], keep: tuple[str, ...], drop: tuple[str, ...] = ()) -> list[str]:
    return [c for c in columns if c.startswith(keep) and not (drop and c.startswith(drop))]


def waits(rows: DataFrame, run: str, step: str, metric: str, delta: float = 0.0) -> DataFrame:
    """rows with `improved` (over all before by the part delta) and `waited`, the steps since the last improvement."""
    order = Window.partitionBy(run).orderBy(step)
    best = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("improved", best.isNull() | (F.col(metric) > best * (1 + delta)))
    marked = marked.withColumn("_group", F.sum(F.col("improved").cast("int")).over(order))
    inside = Window.partitionBy(run, "_group").orderBy(step)
    return marked.withColumn("waited", F.sum((~F.col("improved")).cast("int")).over(inside)).drop("_group")


def ema(rows: DataFrame, run: str, step: str, value: str, alpha: float) -> DataFrame:
    """(run, ema): m <- alpha * x + (1 - alpha) * m from the first value on, at the last step.

    In closed form: each value is weighed by its distance from the end, so values meet in a sum and not in a loop.
    """
    order = Window.partitionBy(run).orderBy(step)
    placed = rows.select(run, F.col(value).alias("x"), F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy(run)).alias("n"))
    weight = F.when(F.col("r") == 1, F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("r")))
    return placed.groupBy(run).agg(F.sum(F.col("x") * weight).alias("ema"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n): how many values of each column are there, most first, then by name."""
    one = rows.agg(*(F.count(c).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in columns)))).orderBy(F.desc("n"), "metric")
