"""Inputs that many queries share, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import argmax, dot, doubles, rounded, sqdist
from .registry import table

#: Rows of `embeddings` with double vectors, and label8: the greatest of the first eight components.
E = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v, CAST(list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS BIGINT) AS label8 FROM embeddings)"
#: All pairs of them.
P = f"{E}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, a.label8 AS mi, b.label8 AS mj, a.label8 = b.label8 AS same, round(list_dot_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)"
#: Rows 2k and 2k + 1 as pair k, with a verdict that follows the distance but for each fifth pair.
POS = f"{E}, q AS (SELECT a.vec_id // 2 AS pair_id, a.label = b.label AS same_label, round(power(list_distance(a.v, b.v), 2), 9) AS dist, round(list_dot_product(a.v, b.v), 9) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), pos AS (SELECT pair_id, (dist < 2.0) <> (pair_id % 5 = 0) AS is_same, dist, score, same_label FROM q)"
FOLD = f"{POS}, f AS (SELECT *, CAST(ntile(10) OVER (ORDER BY pair_id) AS BIGINT) AS fold FROM pos)"
HIST = f"{P}, h AS (SELECT least(1999, greatest(0, CAST(floor((s + 1) * 2000 / 2) AS BIGINT))) AS bin, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg FROM p GROUP BY 1)"
FARS = [1e-1, 1e-2, 1e-3, 1e-4]
LEVELS = "l(far) AS (VALUES (CAST(1e-1 AS DOUBLE)), (CAST(1e-2 AS DOUBLE)), (CAST(1e-3 AS DOUBLE)), (CAST(1e-4 AS DOUBLE)))"


def r6(x: str) -> str:
    """SQL for rounded(x)."""
    return f"(round({x}, 6) + 0.0)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, label8, v)"""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), doubles("embedding").alias("v"), argmax("embedding", 1, 8).alias("label8"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with label8 as its label, as the similarity engine takes them."""
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax("embedding", 1, 8).alias("label"), "embedding")


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, is_same, dist, score, same_label)"""
    e = vectors(spark, sf_dir).withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    even, odd = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1").select("pair_id", F.col("v").alias("w"), F.col("label").alias("other"))
    made = even.join(odd, "pair_id").select("pair_id", rounded(sqdist("v", "w"), 9).alias("dist"), rounded(dot("v", "w"), 9).alias("score"), (F.col("label") == F.col("other")).alias("same_label"))
    return made.withColumn("is_same", (F.col("dist") < 2.0) != (F.col("pair_id") % 5 == 0))


def folded(spark: SparkSession, sf_dir: str, folds: int = 10) -> DataFrame:
    """positional() with `fold`: contiguous folds from 1 on, the first ones greater by one if rows don't divide."""
    pairs = positional(spark, sf_dir)
    return pairs.withColumn("fold", fold_of(F.col("pair_id"), F.lit(pairs.count()), folds))


def fold_of(index: Column, n: Column, folds: int) -> Column:
    """The number (from 1) of the contiguous fold of row `index` (from 0) of n, without a sort."""
    size, more = F.floor(n / folds), n % folds
    big = more * (size + 1)
    return (F.when(index < big, F.floor(index / (size + 1))).otherwise(more + F.floor((index - big) / F.greatest(size, F.lit(1)))) + 1).cast("long")


def rounded_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})
