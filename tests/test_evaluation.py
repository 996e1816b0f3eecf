"""The slot for models and the evaluators: kinds, checks, odd rows."""

import numpy as np
import pytest

from tessera.operators import evaluation
from tessera.plans.evaluators import moved_by_points, reversed_vectors, same_vectors


def rows(spark, n=700):
    return spark.createDataFrame([(i, i % 3, [float(i), 1.0, 2.0]) for i in range(n)], "id long, label long, embedding array<float>").repartition(2)


def test_kinds(spark):
    made = {}
    for kind, (aligned, points, scored) in evaluation.KINDS.items():
        slot = evaluation.Slot(kind, 3, moved_by_points if points else same_vectors, reversed_vectors if aligned else None)
        got = evaluation.extracted(rows(spark), slot, ["embedding"], ["id", "label"])
        assert got.columns == ["id", "label", "embedding"] + ["score"] * scored
        made[kind] = {r.id: (r.label, list(r.embedding), r["score"] if scored else None) for r in got.collect()}
        assert len(made[kind]) == 700
    assert made["model"][5] == (2, [5.0, 1.0, 2.0], None)
    assert made["aligner_model"][5] == (2, [2.0, 1.0, 5.0], None)
    assert made["aligner_points_model"][5] == (2, [7.0, 6.0, 10.0], None)
    assert made["aligner_points_score_model"][5] == (2, [7.0, 6.0, 10.0], 5.0)


def test_wrong_slots(spark):
    with pytest.raises(ValueError):
        evaluation.Slot("other", 3, same_vectors)
    with pytest.raises(ValueError):
        evaluation.Slot("model", 3, same_vectors, reversed_vectors)
    with pytest.raises(ValueError):
        evaluation.extracted(rows(spark), evaluation.Slot("model", 3, same_vectors), ["embedding"], ["embedding"])
    with pytest.raises(Exception, match="the model gave"):
        evaluation.extracted(rows(spark), evaluation.Slot("model", 4, same_vectors), ["embedding"], ["id"]).collect()
    judge = evaluation.evaluator_of("verification", name="x", inputs=["embedding"], keep=["id", "label"])
    with pytest.raises(ValueError):
        judge.evaluate(rows(spark), evaluation.Slot("model", 3, same_vectors, color_space="BGR"))
    with pytest.raises(ValueError):
        evaluation.evaluator_of("other", name="x")


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, [1.0], "y"), (None, [], "z")], "id long, embedding array<float>, k0 string")
    slot = evaluation.Slot("model", 1, lambda: lambda batch: np.array([[-1.0 if v is None or not len(v) else v[0]] for v in batch["embedding"]]))
    got = evaluation.extracted(df, slot, ["embedding"], ["id", "k0"], batch_rows=2).collect()
    assert sorted((r.k0, r.id, r.embedding) for r in got) == [("x", 1, [-1.0]), ("y", 1, [1.0]), ("z", None, [-1.0])]
    assert evaluation.extracted(df.limit(0), slot, ["embedding"], ["id"]).count() == 0
