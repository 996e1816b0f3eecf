"""Samples that follow from keys, and numbers given to rows without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed multipliers and modulus of the sampling key.
A, B, M = 2654435761, 40503, 1000003
#: Rows of a class whose pairs are joined at most, ids of a block of a larger one, and pairs that are looked at at a time.
SMALL, BLOCK, CANDIDATES = 64, 1 << 15, 1 << 20


def pair_key(i: str, j: str) -> Column:
    return (F.col(i) * A + F.col(j) * B) % M


def dense_labels(rows: DataFrame, label: str, out: str) -> DataFrame:
    """rows with `out`: labels numbered from 0 in their order. Only the distinct labels are sorted in one place."""
    ids = rows.select(label).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))
    return rows.join(ids, label)


def numbered(rows: DataFrame, order: list[str], out: str, first: int = 0, buckets: int = 32) -> DataFrame:
    """rows with `out`: their number in the order of columns, the first of which is numeric or one string for all.

    Rows are dealt to ranges of a numeric column by approximate quantiles; each range is numbered alone from the count of those before.
    """
    numeric = next(c for c, kind in rows.dtypes if c in order and kind != "string")
    lead = order[: order.index(numeric)]
    cuts = sorted({x for x in rows.approxQuantile(numeric, [i / buckets for i in range(1, buckets)], 0.01)})
    part = reduce(lambda a, c: a + (F.col(numeric) >= c).cast("int"), cuts, F.lit(0))
    dealt = rows.withColumn("_part", part)
    keys = [*lead, "_part"]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    made = dealt.join(F.broadcast(offsets), keys)
    return made.withColumn(out, (F.row_number().over(inside) + F.col("_before") - 1 + first).cast("long")).drop("_part", "_before")


def permuted(rows: DataFrame, index: str, seed: int) -> DataFrame:
    """(index, place): a permutation of the rows by a key of index and seed."""
    keyed = rows.withColumn("_key", (F.col(index) * A + F.lit(seed * B)) % M)
    return numbered(keyed, ["_key", index], "place").select(index, "place")


def caps(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, cap): class sizes and floor(100 log2 n), at most 10000."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.withColumn("cap", F.least(F.floor(100 * F.log("n") / F.log(F.lit(2.0))), F.lit(10_000)))


def least_keys(a: np.ndarray, b: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): of the pairs i < j of an id of a and one of b the k with the least (pair key, i, j). own: a and b are the same ids.

    A key is the distance from a residue of i to one of j on a circle of M, so the pairs of the least keys stand in short
    ranges of sorted residues. Ranges of growing keys are read until k pairs are held; no others are made.
    """
    if max((int(abs(x).max()) for x in (a, b) if len(x)), default=0) * (A + B) >= 1 << 63:
        raise OverflowError("ids too large for the key of a pair")
    held = (np.zeros(0, np.int64),) * 3
    if not len(a) or not len(b) or not k:
        return held[1:]
    turns = [(a, b)] if own else [(a, b), (b, a)]
    if min(a.min(), b.min()) < 0:  # remainders below zero come before all others: every pair is tried
        sides, first, top = [(x, np.sort(y), None) for x, y in turns], 0, 0
    else:
        sides = []
        for x, y in turns:
            at = y % M * B % M
            order = np.argsort(at, kind="stable")
            sides.append((x, y[order], (-(x % M * A) % M, np.concatenate([at[order], at[order] + M]))))
        first, top = 0, min(M - 1, 4 * k * M // (len(a) * len(b)))
    while True:
        for x, y, circle in sides:
            if circle is None:
                begin, end = np.zeros(len(x), np.int64), np.full(len(x), len(y))
            else:
                begin, end = np.searchsorted(circle[1], circle[0] + first, "left"), np.searchsorted(circle[1], circle[0] + top, "right")
            sums = np.concatenate([[0], np.cumsum(end - begin)])
            at = 0
            while at < len(x):
                to = max(at + 1, int(np.searchsorted(sums, sums[at] + CANDIDATES, "right")) - 1)
                n = end[at:to] - begin[at:to]
                i = np.repeat(x[at:to], n)
                j = y[(np.arange(sums[to] - sums[at]) + np.repeat(begin[at:to] - (sums[at:to] - sums[at]), n)) % len(y)]
                i, j = i[i < j], j[i < j]
                both = tuple(np.concatenate(c) for c in zip(held, (np.fmod(i * A + j * B, M), i, j), strict=True))
                if len(both[0]) > k:
                    near = np.flatnonzero(both[0] <= np.partition(both[0], k - 1)[k - 1])
                    near = near[np.lexsort((both[2][near], both[1][near], both[0][near]))[:k]]
                    both = tuple(c[near] for c in both)
                held, at = both, to
        if len(held[0]) >= k or sides[0][2] is None or top == M - 1:
            return held[1:]
        first, top = top + 1, min(M - 1, 4 * top + 3)


def positive_pairs(rows: DataFrame, index: str, label: str) -> DataFrame:
    """(label, i, j): pairs of one class, as many as its cap, those with the least keys.

    The pairs of small classes are joined. Larger classes are dealt to blocks of ids; each tile of two blocks gives its own
    least keys, as many as the cap, without making the pairs of others.
    """
    kind = rows.schema[label].dataType.simpleString()
    given = rows.select(F.col(label).alias("label"), F.col(index).cast("long").alias("i")).where("i is not null")
    given = given.join(caps(rows, label).withColumnRenamed(label, "label"), "label")
    few = given.where(F.col("n") <= SMALL)
    pairs = few.join(few.select("label", F.col("i").alias("j")), "label").where("i < j").select("label", "cap", "i", "j")
    many = given.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    left = many.select("label", "cap", "i", F.lit(False).alias("side"), F.col("b").alias("lo"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("hi"))
    right = many.select("label", "cap", "i", F.lit(True).alias("side"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("lo"), F.col("b").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a, b = (t.filter(x)["i"].to_numpy() for x in (pc.invert(t["side"]), t["side"]))
        i, j = least_keys(a, b, t["cap"][0].as_py(), t["lo"][0] == t["hi"][0])
        ends = pa.table({"i": i, "j": j})
        for name in ("cap", "label"):
            ends = ends.add_column(0, name, pa.repeat(t[name][0], len(i)))
        yield from ends.to_batches()

    tiles = left.unionByName(right).groupBy("label", "lo", "hi").applyInArrow(run, f"label {kind}, cap long, i long, j long")
    order = Window.partitionBy("label").orderBy(pair_key("i", "j"), "i", "j")
    made = pairs.unionByName(tiles).withColumn("r", F.row_number().over(order)).where("r <= cap")
    return made.select(F.col("label").alias(label), "i", "j")


def least_partner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, key, j): for each id i of a the id j of b with the least (pair key, j), i itself left out; ids without another are missing.

    From the place of i on a circle of M the next residue of a j has the least key; of each residue the two least ids are held, one of which may be i.
    """
    if max((int(abs(x).max()) for x in (a, b) if len(x)), default=0) * (A + B) >= 1 << 63:
        raise OverflowError("ids too large for the key of a pair")
    b = np.unique(b)
    key, best = np.full((2, len(a)), np.iinfo(np.int64).max)
    if min((int(x.min()) for x in (a, b) if len(x)), default=0) < 0:  # remainders below zero come before all others: every pair is tried
        step = max(1, CANDIDATES // max(1, len(b)))
        for at in range(0, len(a), step):
            for to in range(0, len(b), CANDIDATES):
                i, j, part = a[at : at + step], b[to : to + CANDIDATES], slice(at, at + step)
                keys = np.where(i[:, None] == j, np.iinfo(np.int64).max, np.fmod(i[:, None] * A + j * B, M))
                k = keys.argmin(axis=1)  # ids of b are in order, so the first is the least
                near = keys[np.arange(len(i)), k]
                less = near < key[part]
                key[part], best[part] = np.where(less, near, key[part]), np.where(less, j[k], best[part])
    elif len(b):
        at = b % M * B % M
        order = np.argsort(at, kind="stable")
        circle, first = np.unique(at[order], return_index=True)
        least = b[order][first]
        more = np.append(first[1:], len(b)) - first > 1
        second = b[order][np.where(more, first + 1, first)]
        place = -(a % M * A) % M
        for turn in (0, 1):  # the next residue, and the one after it where i alone has the first
            k = (np.searchsorted(circle, place) + turn) % len(circle)
            j = np.where(least[k] == a, second[k], least[k])
            fresh = (j != a) & (key == np.iinfo(np.int64).max)
            key, best = np.where(fresh, (circle[k] - place) % M, key), np.where(fresh, j, best)
    found = key < np.iinfo(np.int64).max
    return a[found], key[found], best[found]


def least_partners(rows: DataFrame, index: str, label: str) -> DataFrame:
    """(index, chosen): for each row one other of its label, that with the least pair key, ties to smaller ones. Labels are dealt to tiles of two blocks of ids."""
    given = rows.select(F.col(label).alias("label"), F.col(index).cast("long").alias("i")).where("i is not null and label is not null")
    blocks = given.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = given.join(blocks, "label").withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("label", "i", F.lit(False).alias("side"), F.col("b").alias("lo"), other.alias("hi"))
    right = placed.select("label", "i", F.lit(True).alias("side"), other.alias("lo"), F.col("b").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a, b = (t.filter(x)["i"].to_numpy() for x in (pc.invert(t["side"]), t["side"]))
        yield from pa.table(dict(zip(("i", "k", "chosen"), least_partner(a, b), strict=True))).to_batches()

    tiles = left.unionByName(right).groupBy("label", "lo", "hi").applyInArrow(run, "i long, k long, chosen long")
    return tiles.groupBy("i").agg(F.min(F.struct("k", "chosen")).alias("b")).select(F.col("i").alias(index), F.col("b.chosen").alias("chosen"))


def negative_pairs(rows: DataFrame, index: str, label: str) -> DataFrame:
    """(label, anchor, other, other_label): ten draws for each positive pair (100 for a class of one), from the rows of all other classes; none if there is one class only.

    Rows are numbered class by class, so that the numbers of the own class are one range, which a draw steps over.
    """
    total = rows.count()
    first = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    sizes = caps(rows, label).withColumn("first", F.coalesce(F.sum("n").over(first), F.lit(0))).where(F.col("n") < total)
    draws = F.when(F.col("n") < 2, F.lit(100)).otherwise(10 * F.least(F.expr("n * (n - 1) div 2"), F.col("cap")))
    drawn = sizes.select(label, "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), draws.cast("long") - 1)).alias("k"))
    d = (F.col("k") * 104729 + F.col(label) * 31) % (F.lit(total) - F.col("n"))
    wanted = drawn.select(label, (F.col("first") + (F.col("k") * 7919 + F.col(label)) % F.col("n")).alias("r"), F.when(d < F.col("first"), d).otherwise(d + F.col("n")).alias("g"))
    inside = F.row_number().over(Window.partitionBy(label).orderBy(index)) - 1
    placed = rows.select(label, index).join(F.broadcast(sizes.select(label, "first")), label).select(label, index, (F.col("first") + inside).alias("r"))
    anchors = placed.select(label, F.col(index).alias("anchor"), "r")
    others = placed.select(F.col(index).alias("other"), F.col(label).alias("other_label"), F.col("r").alias("g"))
    return wanted.join(anchors, [label, "r"]).join(others, "g").select(label, "anchor", "other", "other_label")
