"""All pairs of a vector collection, tile by tile.

Rows are dealt to blocks; each pair of blocks is a tile, whose scores one matrix product gives in slabs of bounded size. A
tile returns only what is asked of it: counts by bin, the pairs beyond a threshold, or its k best. So no cross
join is planned, nothing of the size of the pairs is stored, and tiles are dealt to tasks by key. Where pairs themselves
are asked for, they leave a tile slab by slab, so that a task holds the vectors of its tile, once and as precise as they
came, and the pairs of one slab.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores made at a time: rows by columns of a slab. Its matrices fit a core's cache, and memory for them is taken once and not mapped anew for each.
SLAB, WIDE = 256, 1024
#: Rows of a block at least, where its size is not given.
LEAST_ROWS = 1024
#: Rows of a slab whose pairs are listed: a task holds such a slab about ten times over, as scores, keys, Arrow rows and the JVM's copy.
LISTED = 64
#: Blocks at most that small tiles asked for by block_rows may make, where the cores and BLOCK_BYTES ask for no more: a row travels once for each.
MOST_BLOCKS = 8
#: Bytes of vectors that a block may hold.
BLOCK_BYTES = 64 << 20
#: Scores are rounded to this many places before they are binned, compared or ranked.
PLACES = 9

Tile = tuple[np.ndarray, np.ndarray, np.ndarray]
Slab = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: The rows of a tile, from its slabs or its sides: at once, or a part at a time.
Kernel = Callable[..., pa.Table | Iterator[pa.Table]]
#: Of rows, columns in order of labels: their indices, products, where there is no pair (None: nowhere), and where labels are equal, as rectangles of the products.
Patch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, list[tuple[slice, slice]]]


def grid(left: Tile, right: Tile, own: bool = False, rows: int = SLAB) -> Iterator[Slab]:
    """(left ids, right ids, same label, score) of a tile, slab by slab, the last two as matrices. With own, slabs below the diagonal are left out."""
    ids_a, labels_a, x_a = left
    ids_b, labels_b, x_b = right
    meet = bool(np.isin(labels_a, labels_b).any())
    for at in range(0, len(ids_a), rows):
        a = slice(at, at + rows)
        for to in range(0, len(ids_b), WIDE):
            b = slice(to, to + WIDE)
            if own and ids_b[b][-1] <= ids_a[at]:
                continue
            scores = np.round(x_a[a].astype(np.float64, copy=False) @ x_b[b].astype(np.float64, copy=False).T, PLACES)
            yield ids_a[a], ids_b[b], labels_a[a, None] == labels_b[None, b] if meet else np.zeros(scores.shape, bool), scores


def sides_of(left: Tile, right: Tile) -> tuple[Tile, Tile]:
    """A tile as it is, for kernels that make its products themselves."""
    return left, right


def is_own(left: Tile, right: Tile) -> bool:
    """Whether both sides are the same rows."""
    return len(left[0]) == len(right[0]) and bool((left[0] == right[0]).all())


def patches(left: Tile, right: Tile, scale: float = 1.0, shift: float = 0.0) -> Iterator[Patch]:
    """scale * score + shift, not rounded, of the pairs of a tile, each once. The matrix of products is used again for the next patch.

    Both sides are gone through in order of labels, so pairs of equal labels are a few rectangles and nothing is compared pair by pair.
    """
    own = is_own(left, right)
    twice = own and len(np.unique(left[0])) < len(left[0])
    kinds, ranks = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    ranks = np.where(kinds == kinds, np.arange(len(kinds)), -1)[ranks]  # a missing label (NaN) equals none
    orders, labels = [], []
    for side in (ranks[: len(left[1])], ranks[len(left[1]) :]):
        orders.append(np.argsort(side, kind="stable"))
        labels.append(side[orders[-1]])
    a, b = (np.zeros((n, left[2].shape[1] + 1)) for n in (SLAB, WIDE))
    b[:, -1], held = 1, np.empty(SLAB * WIDE)
    for at in range(0, len(orders[0]), SLAB):
        rows = orders[0][at : at + SLAB]
        a[: len(rows), :-1] = left[2][rows]
        a[: len(rows), :-1] *= scale
        a[: len(rows), -1] = shift
        kinds, first = np.unique(labels[0][at : at + SLAB], return_index=True)
        last = np.append(first[1:], len(rows))
        begin, end = (np.searchsorted(labels[1], kinds, side) for side in ("left", "right"))
        for to in range(at if own else 0, len(orders[1]), WIDE):
            cols = orders[1][to : to + WIDE]
            b[: len(cols), :-1] = right[2][cols]
            u = held[: len(rows) * len(cols)].reshape(len(rows), len(cols))
            np.matmul(a[: len(rows)], b[: len(cols)].T, out=u)
            none = None
            if own and to < at + len(rows):
                none = np.arange(to, to + len(cols)) <= np.arange(at, at + len(rows))[:, None]
            if twice:
                equal = left[0][rows][:, None] == right[0][cols]
                none = equal if none is None else none | equal
            c0, c1 = np.maximum(begin - to, 0), np.minimum(end - to, len(cols))
            yield rows, cols, u, none, [(slice(first[k], last[k]), slice(c0[k], c1[k])) for k in np.flatnonzero((c0 < c1) & (kinds >= 0))]


def bin_counts(left: Tile, right: Tile, low: float, high: float, bins: int, place: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pos, neg) by bin, as place() gives it for rounded scores (below 0: in no bin).

    Products come in units of bins, so that a floor is the bin, except next to an edge, where rounding decides: those scores are rounded and placed.
    """
    scale = bins / (high - low)
    bound = math.prod(float(np.sqrt(max((np.einsum("ij,ij->i", v, v).max() for v in (x[at : at + WIDE].astype(np.float64) for at in range(0, len(x), WIDE))), default=0.0))) for x in (left[2], right[2]))
    edge = scale * 10.0**-PLACES  # twice as far from an edge as rounding reaches
    first = math.floor((-bound - low) * scale) - 2 if math.isfinite(bound) else 0
    size = math.ceil((bound - low) * scale) + 2 - first if math.isfinite(bound) else math.inf
    if edge < 0.01 and bound < 1e4 and size < min(1 << 20, 1e4 * scale):
        every, pos = np.zeros((2, size + 1), np.int64)
        floors, held = np.empty(SLAB * WIDE), np.empty(SLAB * WIDE, np.int64)
        outside = lambda made: np.where(made < 0, size, np.clip(made - first, 0, size - 1))
        for rows, cols, u, none, equal in patches(left, right, scale, edge - low * scale - first):
            f, at = floors[: u.size].reshape(u.shape), held[: u.size].reshape(u.shape)
            np.floor(u, out=f)
            np.copyto(at, f, casting="unsafe")
            np.subtract(u, f, out=u)
            unsure = np.flatnonzero(u.ravel() < 2 * edge)
            if 20 * len(unsure) > u.size:
                scores = left[2][rows].astype(np.float64) @ right[2][cols].astype(np.float64).T
                at[:] = outside(place(np.round(scores, PLACES)))
            elif len(unsure):
                r, c = np.divmod(unsure, len(cols))
                scores = np.einsum("ij,ij->i", left[2][rows[r]].astype(np.float64), right[2][cols[c]].astype(np.float64))
                at[r, c] = outside(place(np.round(scores, PLACES)))
            if none is not None:
                at[none] = size
            every += np.bincount(at.ravel(), minlength=size + 1)
            if equal:
                pos += np.bincount(np.concatenate([at[r, c].ravel() for r, c in equal]), minlength=size + 1)
        middles = place(low + (np.arange(size) + first + 0.5) / scale)
        kept = middles >= 0
        return tuple(np.bincount(middles[kept], weights=x[:-1][kept], minlength=bins).astype(np.int64) for x in (pos, every - pos))
    pos, neg = np.zeros((2, bins), np.int64)
    for _, _, same, s in slabs(left, right):
        at = place(s)
        same, at = same[at >= 0], at[at >= 0]
        pos += np.bincount(at[same], minlength=bins)
        neg += np.bincount(at[~same], minlength=bins)
    return pos, neg


def slabs(left: Tile, right: Tile, rows: int = SLAB) -> Iterator[Slab]:
    """(smaller id, greater id, same label, score) of the pairs of a tile, slab by slab; each pair once."""
    own = is_own(left, right)
    for ids_a, ids_b, same, scores in grid(left, right, own, rows):
        i, j = np.broadcast_arrays(ids_a[:, None], ids_b[None, :])
        take = i < j if own else np.ones(scores.shape, bool)
        yield np.minimum(i, j)[take], np.maximum(i, j)[take], same[take], scores[take]


def tiles_of(batches: Iterator[pa.RecordBatch]) -> list[Tile]:
    """The two sides of a tile, each in order of its ids. A batch is let go once its rows are taken; vectors keep their precision until a slab is scored."""
    parts: tuple[list[Tile], list[Tile]] = [], []
    for t in batches:
        for held, own in zip(parts, (pc.invert(t["side"]), t["side"]), strict=True):
            rows = t.filter(own)
            if rows.num_rows:
                held.append((rows["id"].to_numpy(zero_copy_only=False), rows["label"].to_numpy(zero_copy_only=False), rows["v"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)))
    return [in_order(held) for held in parts]


def in_order(parts: list[Tile]) -> Tile:
    """The parts as one tile in order of ids. The parts go one by one, so that the vectors are not held twice."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
    ids, labels = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    x, end = np.empty((len(ids), parts[0][2].shape[1]), parts[0][2].dtype), len(ids)
    while parts:
        own = parts.pop()[2]
        x[place[end - len(own) : end]] = own
        end -= len(own)
    return ids[order], labels[order], x


def block_size(rows: DataFrame, vector: str, block_rows: int | None) -> tuple[int, int]:
    """(rows, rows of a block): enough blocks that their tiles occupy all cores a few times over, in blocks of at most BLOCK_BYTES.

    A row travels once for each block, so blocks are no smaller than that asks for. Smaller ones by block_rows are made up to MOST_BLOCKS
    of them, as blocks of a fixed size would let what is shuffled grow with the square of the rows; slabs are small in any case.
    """
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks, most = math.ceil(math.sqrt(6 * rows.sparkSession.sparkContext.defaultParallelism)), max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
    if block_rows is None:
        return n, min(most, max(LEAST_ROWS, -(-n // blocks)))
    return n, max(block_rows, min(most, -(-n // max(blocks, MOST_BLOCKS))))


def carried(rows: DataFrame, id_col: str, label: str, vector: str, mark: str = "") -> list[Column]:
    """id, label and vector as the tiles take them; single-precision vectors travel as they are."""
    v = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    return [F.col(id_col).cast("long").alias("id" + mark), F.col(label).cast("long").alias("label" + mark), v.alias("v" + mark)]


def dealt(left: DataFrame, right: DataFrame, keys: list[str], kernel: Kernel, schema: str, parts: Callable[[Tile, Tile], Iterator[Slab]] = slabs) -> DataFrame:
    """kernel's rows of every tile: rows of left and right that agree on keys, which right has with a mark."""
    marked = list(dict.fromkeys([*keys, "id", "label", "v"]))
    both = left.select(*marked, F.lit(False).alias("side")).union(right.select(*(F.col(c + "_") for c in marked), F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tiles_of(batches)
        pa.default_memory_pool().release_unused()
        if all(len(ids) for ids, _, _ in sides):
            made = kernel(parts(*sides))
            for rows in [made] if isinstance(made, pa.Table) else made:
                yield from rows.to_batches()

    return both.groupBy(*keys).applyInArrow(run, schema)


def over_tiles(rows: DataFrame, kernel: Kernel, schema: str, block_rows: int | None = None, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", by_label: bool = False, within: bool = False, parts: Callable[[Tile, Tile], Iterator[Slab]] = slabs) -> DataFrame:
    """kernel's rows of every tile. Ids are distinct. Blocks hold about block_rows rows; without it, block_size chooses.

    With by_label, rows are dealt in order of their labels' hashes to blocks of about equal size, so that most tiles hold no equal labels and compare none.
    With within, only pairs of equal labels are made: each label has blocks of its own, as many as its rows ask for. Rows without a label have no such pairs.
    """
    n, block_rows = block_size(rows, vector, block_rows)
    given = rows.select(*carried(rows, id_col, label, vector))
    blocks = F.lit(max(1, -(-n // block_rows)))
    keys = ["lo", "hi"]
    if within:
        # No more than n / block_rows labels have more than one block, so their table is small.
        large = given.groupBy(F.col("label").alias("l")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
        given = given.where("label is not null").join(F.broadcast(large), F.col("label") == F.col("l"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("l")
        blocks, keys = F.col("blocks"), ["label", *keys]
    block = F.pmod(F.xxhash64("id"), blocks)
    if by_label:
        # Labels alone, not rows, are counted up in one window.
        given = given.withColumn("h", F.xxhash64("label"))
        sizes = given.groupBy("h").agg(F.count("*").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        given = given.join(sizes.withColumn("before", before), "h")
        block = F.least(F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("size"))) * blocks / F.lit(max(1, n))), blocks - 1)
    given = given.withColumn("b", block.cast("int")).withColumn("blocks", blocks)
    left = given.select("id", "label", "v", F.col("b").alias("lo"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("hi"))
    right = given.select(F.col("id").alias("id_"), F.col("label").alias("label_"), F.col("v").alias("v_"), F.col("b").alias("hi_"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("lo_"))
    return dealt(left, right, keys, kernel, schema, parts)


def over_sides(probes: DataFrame, gallery: DataFrame, kernel: Kernel, schema: str, block_rows: int | None = None, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", parts: Callable[[Tile, Tile], Iterator[Slab]] = grid) -> DataFrame:
    """kernel's rows of every tile of a block of probes and a block of the gallery; slabs are those of `grid`."""
    (n, a), (m, b) = (block_size(x, vector, block_rows) for x in (probes, gallery))
    own, other = max(1, -(-n // a)), max(1, -(-m // b))
    place = lambda blocks: F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    left = probes.select(*carried(probes, id_col, label, vector), place(own).alias("lo"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("hi"))
    right = gallery.select(*carried(gallery, id_col, label, vector, "_"), place(other).alias("hi_"), F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("lo_"))
    return dealt(left, right, ["lo", "hi"], kernel, schema, parts)


def side_scores(probes: DataFrame, gallery: DataFrame, **how) -> DataFrame:
    """(probe, gallery, same, score) of every probe with every row of the gallery."""

    def kernel(parts: Iterator[Slab]) -> Iterator[pa.Table]:
        for p, g, same, s in parts:
            i, j = np.broadcast_arrays(p[:, None], g[None, :])
            yield pair_table([(i.ravel(), j.ravel(), same.ravel(), s.ravel())]).rename_columns(["probe", "gallery", "same", "score"])

    return over_sides(probes, gallery, kernel, "probe long, gallery long, same boolean, score double", parts=partial(grid, rows=LISTED), **how)


def best_of_sides(probes: DataFrame, gallery: DataFrame, k: int, **how) -> DataFrame:
    """(probe, gallery, same, score, rank): at least the k best of the gallery for each probe and the best of its own label, ties to smaller ids.

    Each tile keeps its k best and its best of the probe's label, so a probe has k + 1 rows a block of the gallery. Ranks up to k are those in the whole gallery; greater ones only say that k rows are ahead.
    """

    def kernel(parts: Iterator[Slab]) -> pa.Table:
        out = []
        for p, g, same, s in parts:
            take = s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.ones(s.shape, bool)
            mates = np.where(same, s, -np.inf)
            take |= same & (mates == mates.max(axis=1, keepdims=True))
            i, j = np.nonzero(take)
            out.append((p[i], g[j], same[i, j], s[i, j]))
        i, j, same, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))
        keep = np.zeros(len(i), bool)
        for own, most in ((np.arange(len(i)), k), (np.flatnonzero(same), 1)):
            order = own[np.lexsort((j[own], -s[own], i[own]))]
            first = np.flatnonzero(np.diff(i[order], prepend=i[order[:1]] - 1)) if len(order) else np.zeros(0, np.int64)
            place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            keep[order[place < most]] = True
        return pair_table([(i[keep], j[keep], same[keep], s[keep])]).rename_columns(["probe", "gallery", "same", "score"])

    made = over_sides(probes, gallery, kernel, "probe long, gallery long, same boolean, score double", **how)
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "gallery")).cast("long"))


def binned(s: np.ndarray, low: float = -1.0, high: float = 1.0, bins: int = 2000, only_inside: bool = False, inside_of: int | None = None) -> np.ndarray:
    """The bins of scores, as histogram() counts them; -1: none."""

    def place(bins: int) -> np.ndarray:
        return np.clip(np.floor((s - low) * bins / (high - low)), 0, bins - 1).astype(np.int64)

    at = place(bins)
    if inside_of:
        first = place(inside_of) * (bins // inside_of)
        at = np.clip(at, first, first + bins // inside_of - 1)
    return np.where((s >= low) & (s <= high), at, -1) if only_inside else at


def histogram(rows: DataFrame, low: float = -1.0, high: float = 1.0, bins: int = 2000, only_inside: bool = False, inside_of: int | None = None, **how) -> DataFrame:
    """(bin, pos, neg): counts of pairs of equal and of different labels by score, empty bins left out.

    Scores outside low..high go to the end bins, or, with only_inside, nowhere. Rounding can put a score that lies on an edge
    into one coarse bin and into a fine bin of the coarse one beside it. With inside_of, a number of coarse bins that divides
    `bins`, such a score goes to the nearest fine bin of its own coarse bin, so that sums of fine bins are the coarse ones.
    """

    def kernel(sides: tuple[Tile, Tile]) -> pa.Table:
        pos, neg = bin_counts(*sides, low, high, bins, partial(binned, low=low, high=high, bins=bins, only_inside=only_inside, inside_of=inside_of))
        held = np.flatnonzero(pos + neg)
        return pa.table({"bin": held.astype(np.int64), "pos": pos[held], "neg": neg[held]})

    return over_tiles(rows, kernel, "bin long, pos long, neg long", parts=sides_of, **how).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


PAIR = "i long, j long, same boolean, score double"


def pair_table(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    if len(parts) == 1:
        i, j, same, s = parts[0]
    else:
        i, j, same, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))
    return pa.table({"i": i.astype(np.int64, copy=False), "j": j.astype(np.int64, copy=False), "same": same, "score": s})


def pairs_where(rows: DataFrame, neg_from: float | None = None, pos_to: float | None = None, pos_from: float | None = None, **how) -> DataFrame:
    """(i, j, same, score): pairs of different labels at or above neg_from, of equal labels at or below pos_to or at or above pos_from."""

    def kernel(parts: Iterator[Slab]) -> Iterator[pa.Table]:
        for i, j, same, s in parts:
            take = np.zeros(len(s), bool)
            if neg_from is not None:
                take |= ~same & (s >= neg_from)
            if pos_to is not None:
                take |= same & (s <= pos_to)
            if pos_from is not None:
                take |= same & (s >= pos_from)
            yield pair_table([(i[take], j[take], same[take], s[take])])

    return over_tiles(rows, kernel, PAIR, parts=partial(slabs, rows=LISTED), **how)


def all_scores(rows: DataFrame, **how) -> DataFrame:
    """(i, j, same, score) of every pair; the result is of the size of the pairs, what a task holds is not."""
    return pairs_where(rows, neg_from=-np.inf, pos_from=-np.inf, **how)


def score_counts(rows: DataFrame, ranges: list[tuple[float, float]], **how) -> DataFrame:
    """(score, pos, neg): counts of pairs by score, of scores in any of the ranges [low, high). Scores are rounded, so a range has a bounded number of them."""

    def kernel(parts: Iterator[Slab]) -> pa.Table:
        held, counts = np.zeros(0), np.zeros((2, 0), np.int64)
        for _, _, same, s in parts:
            take = np.zeros(len(s), bool)
            for low, high in ranges:
                take |= (s >= low) & (s < high)
            both = np.concatenate([held, s[take]])
            more = np.concatenate([counts, np.stack([same[take], ~same[take]]).astype(np.int64)], axis=1)
            held, at = np.unique(both, return_inverse=True)
            counts = np.stack([np.bincount(at, weights=c, minlength=len(held)) for c in more]).astype(np.int64)
        return pa.table({"score": held, "pos": counts[0], "neg": counts[1]})

    return over_tiles(rows, kernel, "score double, pos long, neg long", **how).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def best_of_tile(left: Tile, right: Tile, k: int, wants: list[tuple[bool | None, bool]]) -> pa.Table:
    """The k best pairs of a tile for each want (same, highest), with its number. Only scores that reach the k-th held are looked at one by one."""
    held = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.float64)) for _ in wants]
    for rows, cols, u, none, _ in patches(left, right):
        for w, (same, highest) in enumerate(wants):
            last = held[w][3][-1] if len(held[w][3]) == k else np.inf * (-1 if highest else 1)
            hit = u >= last - 10.0**-PLACES if highest else u <= last + 10.0**-PLACES
            if none is not None:
                hit &= ~none
            r, c = np.divmod(np.flatnonzero(hit.ravel()), len(cols))
            eq = left[1][rows[r]] == right[1][cols[c]]
            if same is not None:
                r, c, eq = r[eq == same], c[eq == same], eq[eq == same]
            if not len(r):
                continue
            x, y = left[0][rows[r]], right[0][cols[c]]
            i, j, eq, s = (np.concatenate(both) for both in zip(held[w], (np.minimum(x, y), np.maximum(x, y), eq, np.round(u[r, c], PLACES)), strict=True))
            key = -s if highest else s
            near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1]) if len(s) > k else np.arange(len(s))
            keep = near[np.lexsort((j[near], i[near], key[near]))[:k]]
            held[w] = (i[keep], j[keep], eq[keep], s[keep])
    return pair_table(held).append_column("want", pa.array(np.repeat(np.arange(len(wants)), [len(x[0]) for x in held])))


def extremes(rows: DataFrame, k: int, same: bool | None, highest: bool, **how) -> DataFrame:
    """The k pairs of equal (same), of different or (None) of any labels with the highest or lowest scores, ties to smaller i, then j.

    Each tile keeps its own k best, so at most k rows of a tile travel.
    """
    made = over_tiles(rows, lambda sides: best_of_tile(*sides, k, [(same, highest)]), PAIR + ", want long", parts=sides_of, **how).drop("want")
    return made.orderBy(F.desc("score") if highest else F.asc("score"), "i", "j").limit(k)


def several_extremes(rows: DataFrame, k: int, wants: list[tuple[bool | None, bool]], **how) -> DataFrame:
    """The rows of extremes() for each want (same, highest), with its number `want`; all pairs are scored once."""
    made = over_tiles(rows, lambda sides: best_of_tile(*sides, k, wants), PAIR + ", want long", parts=sides_of, **how)
    down = F.col("want").isin([w for w, (_, highest) in enumerate(wants) if highest])
    order = Window.partitionBy("want").orderBy(F.when(down, -F.col("score")).otherwise(F.col("score")), "i", "j")
    return made.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def counts_from(rows: DataFrame, thresholds: list[float], **how) -> DataFrame:
    """(threshold, pos, neg): numbers of pairs of equal and of different labels that score at least each threshold, counted pair by pair in their tiles."""

    def kernel(sides: tuple[Tile, Tile]) -> pa.Table:
        counts = np.zeros((2, len(thresholds)), np.int64)
        for _, _, u, none, equal in patches(*sides):
            np.round(u, PLACES, out=u)
            if none is not None:
                u[none] = -np.inf
            for k, t in enumerate(thresholds):
                hit = u >= t
                pos = sum(int(np.count_nonzero(hit[r, c])) for r, c in equal)
                counts[:, k] += pos, int(np.count_nonzero(hit)) - pos
        return pa.table({"threshold": pa.array(thresholds, pa.float64()), "pos": counts[0], "neg": counts[1]})

    return over_tiles(rows, kernel, "threshold double, pos long, neg long", parts=sides_of, **how).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def verified(rows: DataFrame, least: float, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], label_of: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-6, **how) -> DataFrame:
    """One row (checked, wrong_score, wrong_label): pairs from a score on that chosen(i, j) takes, scored again one by one and labelled again by label_of(vectors).

    They are checked in their tile, where the vectors are; neither pairs nor vectors travel.
    """

    def kernel(sides: tuple[Tile, Tile]) -> pa.Table:
        left, right = sides
        counts = np.zeros(3, np.int64)
        for rows, cols, u, none, equal in patches(left, right):
            s = np.round(u, PLACES)
            hit = s >= least
            if none is not None:
                hit &= ~none
            same = np.zeros(u.shape, bool)
            for r, c in equal:
                same[r, c] = True
            places = np.flatnonzero(hit.ravel())
            for at in range(0, len(places), 1 << 14):
                r, c = np.divmod(places[at : at + (1 << 14)], len(cols))
                i, j = left[0][rows[r]], right[0][cols[c]]
                take = chosen(np.minimum(i, j), np.maximum(i, j))
                r, c = r[take], c[take]
                v, w = left[2][rows[r]].astype(np.float64), right[2][cols[c]].astype(np.float64)
                again = np.einsum("ij,ij->i", v, w)
                counts += len(r), np.count_nonzero(np.abs(again - s[r, c]) > tolerance), np.count_nonzero((label_of(v) == label_of(w)) != same[r, c])
        return pa.table({n: counts[k : k + 1] for k, n in enumerate(("checked", "wrong_score", "wrong_label"))})

    made = over_tiles(rows, kernel, "checked long, wrong_score long, wrong_label long", parts=sides_of, **how)
    return made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("checked", "wrong_score", "wrong_label")))


def nearest_levels(rows: DataFrame, levels: dict[float, float], k: int, **how) -> DataFrame:
    """(far, side, i, j, score): for each level {far: threshold} the k pairs of different labels nearest to it above and below, ties to smaller i, then j.

    Each tile keeps its own k for each level and side.
    """

    def nearest(i: np.ndarray, j: np.ndarray, s: np.ndarray, t: float, above: bool) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero((s >= t) == above)
        gap = np.round(np.abs(s[own] - t), 12)
        near = np.flatnonzero(gap <= np.partition(gap, k - 1)[k - 1]) if len(gap) > k else np.arange(len(gap))
        keep = own[near[np.lexsort((j[own[near]], i[own[near]], gap[near]))[:k]]]
        return i[keep], j[keep], s[keep]

    def kernel(parts: Iterator[Slab]) -> pa.Table:
        held: dict[tuple[float, bool], tuple[np.ndarray, ...]] = {}
        for i, j, same, s in parts:
            i, j, s = i[~same], j[~same], s[~same]
            for far, t in levels.items():
                for above in (True, False):
                    old = held.get((far, above))
                    more = nearest(i, j, s, t, above)
                    held[far, above] = more if old is None else nearest(*(np.concatenate(x) for x in zip(old, more, strict=True)), t, above)
        rows_out = [(far, "above" if above else "below", *x) for (far, above), cols in held.items() for x in zip(*(c.tolist() for c in cols), strict=True)]
        a, b, c, d, e = zip(*rows_out, strict=True) if rows_out else ((),) * 5
        return pa.table({"far": pa.array(a, pa.float64()), "side": pa.array(b, pa.string()), "i": pa.array(c, pa.int64()), "j": pa.array(d, pa.int64()), "score": pa.array(e, pa.float64())})

    made = over_tiles(rows, kernel, "far double, side string, i long, j long, score double", **how)
    threshold = F.coalesce(*(F.when(F.col("far") == far, F.lit(t)) for far, t in levels.items()))
    order = Window.partitionBy("far", "side").orderBy(F.round(F.abs(F.col("score") - threshold), 12), "i", "j")
    return made.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def stats(rows: DataFrame, **how) -> DataFrame:
    """One row: counts, sums, least and greatest scores of pairs of equal and of different labels."""

    def kernel(parts: Iterator[Slab]) -> pa.Table:
        rows_of = {True: [0, 0.0, np.inf, -np.inf], False: [0, 0.0, np.inf, -np.inf]}
        for _, _, same, s in parts:
            for kind in (True, False):
                own = s[same == kind]
                if len(own):
                    r = rows_of[kind]
                    r[0], r[1], r[2], r[3] = r[0] + len(own), r[1] + float(own.sum()), min(r[2], float(own.min())), max(r[3], float(own.max()))
        kept = [(k, *r) for k, r in rows_of.items() if r[0]]
        a, b, c, d, e = zip(*kept, strict=True) if kept else ((),) * 5
        return pa.table({"same": pa.array(a, pa.bool_()), "n": pa.array(b, pa.int64()), "sum": pa.array(c, pa.float64()), "least": pa.array(d, pa.float64()), "most": pa.array(e, pa.float64())})

    made = over_tiles(rows, kernel, "same boolean, n long, sum double, least double, most double", **how)
    return made.groupBy("same").agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def pair_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: numbers of all pairs, of those with equal labels and of the others, from counts by label alone."""
    sizes = rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("c"))
    n = F.coalesce(F.sum("c"), F.lit(0))
    pos = F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0))
    made = sizes.agg(n.alias("n"), pos.alias("n_pos"))
    return made.select(F.expr("n * (n - 1) div 2").alias("n_pairs"), "n_pos", F.expr("n * (n - 1) div 2 - n_pos").alias("n_neg"))
