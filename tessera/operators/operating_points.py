"""Thresholds and rates from scores of pairs that are the same or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def levels(df: DataFrame, values: list[float], name: str = "far") -> DataFrame:
    """A short table of constants in the session of df."""
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name))


def running(df: DataFrame, key: str, sums: list[str], descending: bool = False, buckets: int = 32) -> DataFrame:
    """df (one row per key) with `cum_<c>` for each c of sums: totals up to and with the key's row.

    Keys are dealt to ranges by approximate quantiles; totals run within a range, and the totals of earlier ranges, one row
    for each, are added. So no task holds more than its range.
    """
    cuts = sorted({x for x in df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01)}) if buckets > 1 else []
    part = reduce(lambda a, c: a + (F.col(key) >= c).cast("int"), cuts, F.lit(0)).alias("_part")
    dealt = df.select("*", part)
    order = F.desc(key) if descending else F.asc(key)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums))
    made = dealt.join(F.broadcast(offsets), "_part")
    for c in sums:
        made = made.withColumn(f"cum_{c}", F.sum(c).over(inside) + F.col(f"_o_{c}"))
    return made.drop("_part", *(f"_o_{c}" for c in sums))


def cumulated(hist: DataFrame) -> DataFrame:
    """hist (bin, pos, neg) with totals from the highest bin down. A histogram has no more rows than bins, so one window serves."""
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("bin", "pos", "neg", F.sum("pos").over(down).alias("cum_pos"), F.sum("neg").over(down).alias("cum_neg"))


def tpir_from_hist(hist: DataFrame, fars: list[float], low: float = -1.0, high: float = 1.0, bins: int = 2000) -> DataFrame:
    """(far, threshold, tpir): the left edge of the highest bin from which on far of all negatives are reached, and the part of positives there.

    Without such a bin the threshold is `low` and the rate 1; without positives the rate is 0. The histogram is made once, as a table: all its
    pairs would be scored again for each place that reads it.
    """
    hist = written(hist)
    both = hist.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    wanted = levels(hist, fars).join(F.broadcast(both))
    reached = wanted.join(cumulated(hist), F.col("cum_neg") >= F.col("far") * F.col("n_neg")).groupBy("far").agg(F.max_by(F.struct("bin", "cum_pos"), "bin").alias("at"))
    joined = wanted.join(reached, "far", "left")
    rate = F.when(F.col("n_pos") == 0, F.lit(0.0)).when(F.col("at").isNull(), F.lit(1.0)).otherwise(F.col("at.cum_pos") / F.col("n_pos"))
    return joined.select("far", F.when(F.col("at").isNull(), F.lit(low)).otherwise(low + F.col("at.bin") * ((high - low) / bins)).alias("threshold"), rate.alias("tpir"))


def threshold_by_rank(scores: DataFrame, ranks: DataFrame, rank: str, bins: int = 1 << 16) -> DataFrame:
    """ranks with `threshold`: the score at that rank (from 1) from the top, the lowest if there are fewer. Ranks are few; lower ones than 1 have no row.

    Counts by bin say in which bin a rank lies; then only the scores of those bins are counted, each in a window of its own.
    """
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    binned = scores.where("score is not null").select("score").join(F.broadcast(ends)).select("score", F.least(F.floor((F.col("score") - F.col("low")) / width * bins), F.lit(bins - 1)).alias("bin"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    coarse = binned.groupBy("bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down))
    total = coarse.agg(F.max("upto").alias("total"))
    wanted = ranks.where(F.col(rank) >= 1).join(F.broadcast(total)).withColumn("place", F.least(F.col(rank), F.col("total"))).drop("total")
    found = wanted.join(coarse, (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n"))).withColumn("place", F.col("place") - F.col("upto") + F.col("n")).drop("upto", "n")
    inside = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    fine = binned.join(F.broadcast(found.select("bin").distinct()), "bin", "left_semi").groupBy("bin", "score").agg(F.count("*").alias("c")).withColumn("last", F.sum("c").over(inside))
    return fine.join(F.broadcast(found), "bin").where((F.col("place") <= F.col("last")) & (F.col("place") > F.col("last") - F.col("c"))).drop("bin", "place", "last", "c").withColumnRenamed("score", "threshold")


def confusion(pairs: DataFrame, accepted) -> DataFrame:
    """One row: tp, fp, tn, fn, tpr, fpr, accuracy; rates without a denominator are 0."""
    yes, same = accepted, F.col("is_same")
    made = pairs.agg(*(F.count_if(c).alias(n) for n, c in (("tp", yes & same), ("fp", yes & ~same), ("tn", ~yes & ~same), ("fn", ~yes & same))))
    rate = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return made.select("tp", "fp", "tn", "fn", rate(tp, tp + fn).alias("tpr"), rate(fp, fp + tn).alias("fpr"), rate(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def by_score(pairs: DataFrame) -> DataFrame:
    """(score, pos, neg): counts of equal scores."""
    return pairs.groupBy("score").agg(F.count_if("is_same").alias("pos"), F.count_if(~F.col("is_same")).alias("neg"))


def roc(pairs: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr): rates of pairs with a score at or above each score that occurs."""
    both = pairs.agg(F.count_if("is_same").alias("n_pos"), F.count_if(~F.col("is_same")).alias("n_neg"))
    made = running(by_score(pairs), "score", ["pos", "neg"], descending=True).join(F.broadcast(both))
    return made.select(F.col("score").alias("threshold"), (F.col("cum_pos") / F.col("n_pos")).alias("tpr"), (F.col("cum_neg") / F.col("n_neg")).alias("fpr"))


def grid_counts(pairs: DataFrame, value: str, steps: int, per_unit: int, group: str) -> DataFrame:
    """(group, k, same, other) for k = 0 ... steps - 1: pairs of the group whose value lies below k / per_unit.

    A pair is counted at the first k that lies above its value, and counts run up the grid, so pairs never meet all thresholds.
    """
    k = F.floor(F.col(value) * per_unit).cast("long")
    k = F.when(k / F.lit(float(per_unit)) > F.col(value), k).otherwise(k + 1)
    first = pairs.select(group, F.greatest(k, F.lit(0)).alias("k"), "is_same").groupBy(group, "k").agg(F.count_if("is_same").alias("s"), F.count_if(~F.col("is_same")).alias("o"))
    grid = pairs.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("k"))
    filled = grid.join(first.where(F.col("k") < steps), [group, "k"], "left")
    up = Window.partitionBy(group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(group, "k", F.sum(F.coalesce("s", F.lit(0))).over(up).alias("same"), F.sum(F.coalesce("o", F.lit(0))).over(up).alias("other"))


def fold_best(pairs: DataFrame, steps: int = 400, per_unit: int = 100, folds: str = "fold") -> DataFrame:
    """(fold, threshold, train_accuracy, test_accuracy): the first threshold of the grid that is best on all other folds."""
    counts = grid_counts(pairs, "dist", steps, per_unit, folds)
    sizes = pairs.groupBy(folds).agg(F.count("*").alias("n"), F.count_if(~F.col("is_same")).alias("n_other"))
    right = counts.join(F.broadcast(sizes), folds).select(folds, "k", "n", (F.col("same") + F.col("n_other") - F.col("other")).alias("right"))
    every = right.groupBy("k").agg(F.sum("right").alias("all_right"), F.sum("n").alias("all_n"))
    made = right.join(F.broadcast(every), "k").withColumn("train_accuracy", (F.col("all_right") - F.col("right")) / (F.col("all_n") - F.col("n")))
    best = Window.partitionBy(folds).orderBy(F.desc("train_accuracy"), "k")
    return made.withColumn("r", F.row_number().over(best)).where("r = 1").select(folds, (F.col("k") / F.lit(float(per_unit))).alias("threshold"), "train_accuracy", (F.col("right") / F.col("n")).alias("test_accuracy"))
