"""Queries that bring rows to vectors by a function and evaluate them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from ..operators import evaluation
from .base import HIST, LEVELS, P, r6
from .registry import query, table

WIDTH = 64


def same_vectors():
    """A model that gives the rows' own vectors."""
    return lambda batch: np.asarray(batch["embedding"], np.float32)


def reversed_vectors():
    """An aligner that turns each vector round and scores it by its first number."""
    return lambda batch: {"embedding": np.asarray(batch["embedding"])[:, ::-1], "points": np.asarray(batch["embedding"])[:, :2], "score": np.asarray(batch["embedding"])[:, 0].astype(float)}


def moved_by_points():
    """A model that adds a row's first point to all numbers."""
    return lambda batch, points: np.asarray(batch["embedding"], np.float32) + np.asarray(points, np.float32)[:, :1]


@query("SELECT vec_id, round(CAST(embedding[len(embedding)] + embedding[1] AS DOUBLE), 5) + 0.0 AS first, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS score FROM embeddings")
def infer_slot(spark, sf_dir):
    """All rows through an aligner and a model that takes its points."""
    rows = table(spark, sf_dir, "embeddings")
    slot = evaluation.Slot("aligner_points_score_model", WIDTH, moved_by_points, reversed_vectors)
    made = evaluation.extracted(rows, slot, ["embedding"], ["vec_id"])
    return made.select("vec_id", (F.round(F.col("embedding")[0].cast("double"), 5) + 0.0).alias("first"), (F.round("score", 6) + 0.0).alias("score"))


TPIR = f"{HIST}, {LEVELS}, n AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM h), c AS (SELECT bin, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM h WINDOW w AS (ORDER BY bin DESC)), b AS (SELECT far, min(cp) AS cp FROM l, n JOIN c ON cn >= far * nn GROUP BY far)"


@query(f"WITH {TPIR} SELECT 'val/all/tpir@' || printf('%.0e', l.far) AS metric, {r6('CASE WHEN np = 0 THEN 0 WHEN cp IS NULL THEN 1 ELSE cp * 1.0 / np END')} AS value, CAST(1 AS BIGINT) AS epoch, CAST(20 AS BIGINT) AS step, CAST(300 AS BIGINT) AS seen FROM n, l LEFT JOIN b ON b.far = l.far")
def eval_identification(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", argmax("embedding", 1, 8).alias("label8"), "embedding")
    judge = evaluation.evaluator_of("identification:label8", name="all", inputs=["embedding"], keep=["vec_id", "label8"])
    return judge.log(judge.evaluate(rows, evaluation.Slot("model", WIDTH, same_vectors)), 1, 20, 300)


@query(f"WITH {P}, v AS (SELECT same, s >= 0.1 AS yes FROM p WHERE i % 2 = 0 AND j = i + 1) SELECT unnest(['tpr', 'fpr', 'accuracy']) AS metric, unnest([{r6('coalesce(count(*) FILTER (same AND yes) * 1.0 / nullif(count(*) FILTER (same), 0), 0)')}, {r6('coalesce(count(*) FILTER (NOT same AND yes) * 1.0 / nullif(count(*) FILTER (NOT same), 0), 0)')}, {r6('count(*) FILTER (same = yes) * 1.0 / count(*)')}]) AS value FROM v")
def eval_verification(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), argmax("embedding", 1, 8).alias("label8"), "embedding")
    judge = evaluation.evaluator_of("verification", name="pairs", inputs=["embedding"], keep=["pair", "label8"], threshold=0.1)
    return judge.evaluate(rows, evaluation.Slot("model", WIDTH, same_vectors))
