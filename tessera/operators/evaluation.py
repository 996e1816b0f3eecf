"""A slot for a function from rows to vectors, and evaluators by kind over what it gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from . import operating_points, similarity

Batch = dict[str, object]

#: What a slot's parts are given and give, by kind: whether there is an aligner, whether the model takes its points, whether a score comes out too.
KINDS = {"model": (False, False, False), "aligner_model": (True, False, False), "aligner_points_model": (True, True, False), "aligner_points_score_model": (True, True, True)}


@dataclass(frozen=True)
class Slot:
    """How a batch of rows becomes vectors.

    `model()` and `aligner()` are called once in each task and give a function. An aligner takes the batch (columns as column() gives them) and
    gives the batch for the model, with `points` for the kinds that pass them on and `score` for the kind that keeps it. A model takes a
    batch, and the points if its kind has them, and gives an array (rows, width). `color_space` is compared with the evaluator's.
    """

    kind: str
    width: int
    model: Callable[[], Callable[..., np.ndarray]]
    aligner: Callable[[], Callable[[Batch], Batch]] | None = None
    color_space: str = "RGB"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no kind of slot is called {self.kind}; there are {', '.join(KINDS)}")
        if KINDS[self.kind][0] != (self.aligner is not None):
            raise ValueError(f"a slot of kind {self.kind} has {'an' if KINDS[self.kind][0] else 'no'} aligner")

    def function(self) -> Callable[[Batch], tuple[np.ndarray, np.ndarray | None]]:
        _, points, score = KINDS[self.kind]
        model, aligner = self.model(), self.aligner and self.aligner()

        def run(batch: Batch) -> tuple[np.ndarray, np.ndarray | None]:
            seen = aligner(batch) if aligner else batch
            made = np.asarray(model(seen, seen["points"]) if points else model(seen), np.float32)
            return made, np.asarray(seen["score"], np.float64) if score else None

        return run


def column(values: pa.Array) -> object:
    """A column as a model takes it, alike in every batch: numbers as an array of doubles (null: NaN), lists of numbers as a list of arrays (null: None), else a list."""
    kind = values.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    if (pa.types.is_list(kind) or pa.types.is_large_list(kind)) and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)):
        return [None if x is None else x.values.to_numpy(zero_copy_only=False) for x in (v if v.is_valid else None for v in values)]
    return values.to_pylist()


def extracted(rows: DataFrame, slot: Slot, inputs: list[str], keep: list[str], batch_rows: int = 256) -> DataFrame:
    """The columns `keep` of all rows, with `embedding` (array<float>), and `score` if the slot's kind gives one.

    The model sees `inputs` in batches of at most `batch_rows`; nulls reach it as they are. Rows are not shuffled and each comes out
    once; a model that gives another number of rows or another width stops the query. An empty table gives no rows.
    """
    scored = KINDS[slot.kind][2]
    clash = {"embedding", "score"}.intersection(keep)
    if clash:
        raise ValueError(f"the result has own columns {sorted(clash)}")
    kept, taken = [f"k{i}" for i in range(len(keep))], [f"x{i}" for i in range(len(inputs))]
    sent = rows.select(*(F.col(c).alias(n) for c, n in zip(keep + inputs, kept + taken, strict=True)))
    types = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    names = [*kept, "embedding"] + ["score"] * scored
    schema = ", ".join([f"{n} {types[n]}" for n in kept] + ["embedding array<float>"] + ["score double"] * scored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            for first in range(0, batch.num_rows, batch_rows):
                function = function or slot.function()
                part = batch.slice(first, batch_rows)
                made, score = function({c: column(part.column(n)) for c, n in zip(inputs, taken, strict=True)})
                if made.shape != (part.num_rows, slot.width):
                    raise ValueError(f"the model gave {made.shape}, not {(part.num_rows, slot.width)}")
                if scored and score.shape != (part.num_rows,):
                    raise ValueError(f"the aligner gave scores of shape {score.shape} for {part.num_rows} rows")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * slot.width), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), vectors] + ([pa.array(score)] if scored else []), names)

    made = sent.mapInArrow(run, schema)
    return made.select(*(F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)), "embedding", *["score"] * scored)


EVALUATORS: dict[str, type[Evaluator]] = {}


def evaluator(kind: str):
    """Registers a class of evaluators under a kind."""

    def add(cls):
        if kind in EVALUATORS:
            raise ValueError(f"{kind} is registered twice")
        EVALUATORS[kind] = cls
        return cls

    return add


def evaluator_of(kind: str, **how) -> Evaluator:
    """An evaluator by kind; what follows a colon is its mode (`identification:label`)."""
    base, _, mode = kind.partition(":")
    if base not in EVALUATORS:
        raise ValueError(f"no evaluator is called {base}; there are {', '.join(sorted(EVALUATORS))}")
    return EVALUATORS[base](**how, **({"mode": mode} if mode else {}))


@dataclass
class Evaluator:
    """extract() gives vectors of rows, compute_metric() (metric, value) of those, evaluate() both in turn."""

    name: str
    inputs: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    color_space: str = "RGB"
    mode: str = ""

    def integrity_check(self, slot: Slot) -> None:
        if slot.color_space != self.color_space:
            raise ValueError(f"{self.name} has rows in {self.color_space}, the model takes {slot.color_space}")

    def extract(self, rows: DataFrame, slot: Slot) -> DataFrame:
        return extracted(rows, slot, self.inputs, self.keep)

    def compute_metric(self, vectors: DataFrame) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, rows: DataFrame, slot: Slot) -> DataFrame:
        self.integrity_check(slot)
        return self.compute_metric(self.extract(rows, slot))

    def log(self, result: DataFrame, epoch: int = 0, step: int = 0, seen: int = 0) -> DataFrame:
        """(metric, value, epoch, step, seen), with metrics named after the evaluator."""
        return result.select(F.concat(F.lit(f"val/{self.name}/"), "metric").alias("metric"), "value", *(F.lit(n).cast("long").alias(c) for c, n in (("epoch", epoch), ("step", step), ("seen", seen))))


@evaluator("identification")
@dataclass
class Identification(Evaluator):
    """Acceptance of all pairs at false-accept rates; keep names the row's key and its label, `mode` the label where it is another column."""

    fars: tuple[float, ...] = (1e-1, 1e-2, 1e-3, 1e-4)

    def compute_metric(self, vectors: DataFrame) -> DataFrame:
        hist = similarity.histogram(vectors, id_col=self.keep[0], label=self.mode or self.keep[1])
        made = operating_points.tpir_from_hist(hist, list(self.fars))
        return made.select(F.format_string("tpir@%.0e", "far").alias("metric"), rounded("tpir").alias("value"))


@evaluator("verification")
@dataclass
class Verification(Evaluator):
    """Confusion of the pairs of rows that share a number: keep names that number and the label; a pair is accepted from `threshold` on."""

    threshold: float = 0.3

    def compute_metric(self, vectors: DataFrame) -> DataFrame:
        number, label = self.keep[:2]
        sides = F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("embedding").alias("v"))))
        pairs = vectors.groupBy(number).agg(sides.alias("s")).where(F.size("s") == 2)
        score = F.aggregate(F.zip_with(F.col("s")[0]["v"], F.col("s")[1]["v"], lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
        counted = operating_points.confusion(pairs.select((F.col("s")[0]["l"] == F.col("s")[1]["l"]).alias("is_same"), score.alias("score")), F.col("score") >= self.threshold)
        names = ["tpr", "fpr", "accuracy"]
        return counted.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), rounded(n).alias("value")) for n in names))))
