"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue per query, exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

#: Vectors that the trees are fitted on and leaves are counted by at most; every vector is indexed.
SAMPLE = 16_384
#: Rows of a leaf on average, levels of a tree at most, queries of the sample that tell how many leaves to visit.
LEAF, DEEPEST, ASKED = 256, 16, 256
#: Rows and queries that meet in one task at most.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 8_192
#: Rounding of a matrix product of unit vectors is far below this.
CLOSE = 1e-12


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2 and splits at directions[level] . x = cuts[i]."""

    directions: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.directions)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        side = x @ self.directions.T
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (side[:, level] > self.cuts[node])
        return node - len(self.cuts)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """For each leaf, the sum of squared distances of one unit vector to the splits that part it from the leaf."""
        side, far = self.directions @ x, np.zeros(1)
        for level in range(self.depth):
            m = side[level] - self.cuts[(1 << level) - 1 : (2 << level) - 1]
            far = np.stack([far + np.where(m > 0, m * m, 0), far + np.where(m > 0, 0, m * m)], axis=1).ravel()
        return far


def fit(sample: np.ndarray, trees: int, depth: int, seed: int) -> list[Tree]:
    """Trees over unit vectors: each level has a random direction, at right angles to those before while there are some, and each node cuts at the median of its vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    made = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-depth // dim))]
        directions = np.concatenate(blocks)[:depth] if depth else np.zeros((0, dim))
        side = sample @ directions.T
        cuts, node = np.zeros((1 << depth) - 1), np.zeros(len(sample), np.int64)
        for level in range(depth):
            order = np.lexsort((side[:, level], node))
            first = np.searchsorted(node[order], np.arange((1 << level) - 1, (2 << level)))
            here = np.flatnonzero(first[1:] > first[:-1])
            size = first[1:][here] - first[:-1][here]
            low, high = first[:-1][here] + (size - 1) // 2, first[:-1][here] + size // 2
            cuts[(1 << level) - 1 + here] = (side[order[low], level] + side[order[high], level]) / 2
            node = 2 * node + 1 + (side[:, level] > cuts[node])
        made.append(Tree(directions, cuts))
    return made


def probe(forest: list[Tree], x: np.ndarray, leaves: int, held: set[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """The first `leaves` (tree, leaf) of one unit vector, by a queue that all trees share; only those in `held`, which have rows.

    The queue is ordered by Tree.distances, which grows along a path.
    """
    sides = [(t.directions @ x).tolist() for t in forest]
    queue: list[tuple[float, int, int, int]] = [(0.0, t, 0, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < leaves:
        far, t, node, level = heapq.heappop(queue)
        cuts, side = forest[t].cuts, sides[t]
        while level < len(side):
            m = side[level] - cuts[node]
            level += 1
            heapq.heappush(queue, (far + m * m, t, 2 * node + 1 + (m <= 0), level))
            node = 2 * node + 1 + (m > 0)
        if held is None or (t, node - len(cuts)) in held:
            found.append((t, node - len(cuts)))
    return found


def leaves_for(forest: list[Tree], sample: np.ndarray, k: int, recall: float) -> int:
    """How many leaves of the shared queue hold at least `recall` of the k nearest, over ASKED vectors of the sample among its other vectors."""
    asked = np.linspace(0, len(sample) - 1, min(len(sample), ASKED)).astype(int)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(forest)
    leaf = np.stack([t.leaf(sample) for t in forest])
    first = np.cumsum([0, *(len(t.cuts) + 1 for t in forest[:-1])])[:, None]
    need = []
    for q in asked:
        score = sample @ sample[q]
        score[q] = -np.inf
        near = np.argpartition(-score, k - 1)[:k]
        order = np.argsort(np.concatenate([t.distances(sample[q]) for t in forest]), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        need.append(rank[leaf[:, near] + first].min(axis=0) + 1)
    return max(len(forest), int(np.quantile(np.concatenate(need), recall, method="higher")))


def valid_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite components that is not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that products of components neither overflow nor vanish; a cosine stays what it is."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of each row and its x. The sum over components runs in one order, so a pair has one score everywhere."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 14):
        a, b = scaled(rows[i : i + (1 << 14)]), scaled(x[i : i + (1 << 14)])
        out[i : i + (1 << 14)] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return out


def best_pairs(leaf: np.ndarray, least: np.ndarray, rows: np.ndarray, query: np.ndarray, visited: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k nearest of each query among the rows of the leaves it visits, ties to the smaller `least`.

    query and visited: pairs of a number of x and a leaf. Matrix products leave the rows that may be among the nearest of a leaf, which are then scored exactly.
    """
    by_leaf, by_visit = np.argsort(leaf, kind="stable"), np.argsort(visited, kind="stable")
    u, ux = unit(rows), unit(x)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for name in np.unique(visited):
        own = by_leaf[np.searchsorted(leaf, name, sorter=by_leaf) : np.searchsorted(leaf, name, "right", sorter=by_leaf)]
        asks = query[by_visit[np.searchsorted(visited, name, sorter=by_visit) : np.searchsorted(visited, name, "right", sorter=by_visit)]]
        for i in range(0, len(asks) if len(own) else 0, 256):
            some = asks[i : i + 256]
            score = ux[some] @ u[own].T
            if len(own) > k:
                at, row = np.nonzero(score >= np.partition(score, len(own) - k, axis=1)[:, len(own) - k, None] - CLOSE)
            else:
                at, row = (z.ravel() for z in np.indices(score.shape))
            found.append((some[at], own[row]))
    q, r = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    score = cosines(rows[r], x[q])
    order = np.lexsort((least[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], score[keep]


def nearest(rows: DataFrame, is_query: str, k: int = 5, trees: int = 4, recall: float = 0.95, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding", leaves: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (SQL over id) holds, its k nearest found among all other rows, by cosine.

    Equal vectors are one class with its k + 1 least ids, which is all that a list of k can need; so copies of a
    vector never fill a leaf. Trees are fitted on at most SAMPLE classes (those with the least hashes), with about LEAF rows to a leaf; every class is in
    one leaf of each tree. How many leaves a query visits is read off the sample: as many as hold `recall` of its nearest there (`leaves` overrides it). Neighbouring leaves of a tree form
    a group; rows of a group and queries that visit leaves of it meet in blocks of BLOCK_ROWS and BLOCK_QUERIES at most.
    Rows with a null id, or a vector that is null, zero or holds null or non-finite components, take no part, nor do
    vectors of another length than the commonest (of equally common ones, the shortest). Equal rows count once; rows of one id with other vectors are rows of their own,
    as queries and as candidates. Ties go to smaller ids; an empty table gives no rows.
    """
    usable = valid_vectors(rows, id_col, vector)
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    # A vector is known by 128 bits of hashes.
    named = usable.where(F.size("v") == (sizes["dim"] if sizes else 0)).withColumn("ha", F.xxhash64("v")).withColumn("hb", F.xxhash64("v", F.lit(1)))
    each = cut(named.dropDuplicates(["id", "ha", "hb"]))
    # The least ids of each class: Spark keeps k + 1 rows of a class in each task before it deals them out.
    least = Window.partitionBy("ha", "hb").orderBy("id")
    first = each.select("id", "ha", "hb").withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    listed = first.groupBy("ha", "hb").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    classes = cut(each.join(listed, ["id", "ha", "hb"]).withColumn("class", F.monotonically_increasing_id()).withColumnRenamed("id", "least"))
    asking = cut(each.where(F.expr(is_query)).select(F.col("id").alias("query_id"), "ha", "hb").join(classes.select("ha", "hb", "class"), ["ha", "hb"]).select("query_id", "class"))
    n = classes.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], out_schema)
    sample = unit(np.array([r["v"] for r in classes.orderBy("ha", "hb").limit(SAMPLE).select("v").collect()]))
    depth = max(0, min(DEEPEST, math.ceil(math.log2(n / LEAF)) if n > LEAF else 0))
    fitted = fit(sample, trees, depth, seed)
    visits_of = leaves or leaves_for(fitted, sample, k, recall)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    del sample, fitted
    # Groups of leaves with about BLOCK_ROWS rows; a name holds the tree, and then the leaf.
    inside = depth - max(0, min(depth, math.ceil(math.log2(n / BLOCK_ROWS)) if n > BLOCK_ROWS else 0))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(2)))
                for t, tree in enumerate(shared.value):
                    leaf = tree.leaf(x) + (t << DEEPEST)
                    yield pa.RecordBatch.from_arrays([pa.array((leaf >> inside).astype(np.int32)), pa.array(leaf.astype(np.int32)), *batch.columns], ["bunch", "leaf", "class", "least", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1))
            for i in range(0, batch.num_rows, 64):
                own, bunch, lists = [], [], []
                for j in range(i, min(i + 64, batch.num_rows)):
                    leaf = np.sort([(t << DEEPEST) + f for t, f in probe(shared.value, x[j], visits_of, held)])
                    ends = np.flatnonzero(np.diff(leaf >> inside, append=-1)) + 1
                    for part in np.split(leaf, ends[:-1]):
                        own.append(j), bunch.append(part[0] >> inside), lists.append(part)
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bunch, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(lists, pa.list_(pa.int32()))], ["bunch", "query", "x", "leaves"])

    indexed = cut(classes.select("class", "least", "v").mapInArrow(tidy(index), "bunch int, leaf int, class long, least long, v array<double>"))
    # At most trees * 2**DEEPEST leaves, so the counts are bounded.
    held = {(r["leaf"] >> DEEPEST, r["leaf"] & ((1 << DEEPEST) - 1)) for r in indexed.select("leaf").distinct().collect()}
    asked = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "v")
    visits = cut(asked.mapInArrow(tidy(visit), "bunch int, query long, x array<double>, leaves array<int>"))
    parts = lambda df, most, name: df.groupBy("bunch").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = cut(parts(indexed, BLOCK_ROWS, "rows").join(parts(visits, BLOCK_QUERIES, "asks"), "bunch"))
    dealt = lambda key, own, other: [F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)]
    left = indexed.join(F.broadcast(blocks), "bunch").select("bunch", "leaf", "class", "least", "v", *dealt("class", "rows", "asks"))
    right = visits.join(F.broadcast(blocks), "bunch").select("bunch", "query", "x", "leaves", *dealt("query", "asks", "rows"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        lists = right["leaves"].combine_chunks()
        pairs = np.repeat(np.arange(right.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        ids = left["least"].to_numpy()
        q, r, score = best_pairs(left["leaf"].to_numpy(), ids, matrix(left["v"].combine_chunks()), *pairs, matrix(right["x"].combine_chunks()), k + 1)
        return pa.table({"query": right["query"].to_numpy()[q], "class": left["class"].to_numpy()[r], "least": ids[r], "score": score})

    key = ["bunch", "rows", "asks"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "query long, class long, least long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    short = found.groupBy("query", "class").agg(F.first("least").alias("least"), F.first("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # Classes become ids again, and each asking id its own list without itself.
    listed = short.join(classes.select("class", "ids"), "class").select("query", "class", "score", F.explode("ids").alias("vec_id"))
    per_class = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    numbered = listed.withColumn("r", F.row_number().over(per_class)).where(F.col("r") <= k + 1)
    lists = numbered.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "class"))).alias("found"))
    own = asking.join(lists, asking["class"] == lists["query"]).withColumn("found", F.slice(F.filter("found", lambda x: (x["vec_id"] != F.col("query_id")) | (x["class"] != F.col("query"))), 1, k))
    return own.select("query_id", F.posexplode("found").alias("r", "f")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
