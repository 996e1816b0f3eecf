"""Invariants, edge cases and formats."""

import json
import os
import struct
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles
from tessera.operators import graph, history, sampling
from tessera.operators import operating_points as points
from tessera.operators import similarity as sim
from tessera.plans import base
from tessera.sources import files, recordio
from tessera.streaming import queue, windows


def collection(spark, vectors, labels):
    return spark.createDataFrame([(i, int(l), [float(x) for x in v]) for i, (v, l) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, label long, embedding array<double>")


@pytest.mark.parametrize("block_rows", [7, 64, 10_000])
def test_pairs_are_conserved(spark, block_rows):
    rng = np.random.default_rng(1)
    n = 150
    rows = collection(spark, rng.standard_normal((n, 8)), rng.integers(0, 6, n))
    hist = sim.histogram(rows, low=-20, high=20, bins=50, block_rows=block_rows).agg(F.sum("pos"), F.sum("neg")).first()
    counts = sim.pair_counts(rows).first()
    assert (hist[0], hist[1]) == (counts["n_pos"], counts["n_neg"]) and sum(hist) == n * (n - 1) // 2
    pairs = {(r.i, r.j) for r in sim.all_scores(rows, block_rows=block_rows).collect()}
    assert len(pairs) == n * (n - 1) // 2 and all(i < j for i, j in pairs)


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_pairs_within_labels(spark, block_rows):
    rng = np.random.default_rng(2)
    labels = np.where(rng.random(90) < 0.6, 0, rng.integers(1, 30, 90))
    rows = collection(spark, rng.standard_normal((90, 4)), labels).unionByName(spark.sql("select 900L as vec_id, cast(null as long) as label, array(1d, 0d, 0d, 0d) as embedding"))
    got = sorted((r.i, r.j) for r in sim.all_scores(rows, within=True, block_rows=block_rows).collect())
    assert got == [(i, j) for i in range(90) for j in range(i + 1, 90) if labels[i] == labels[j]]


def largest_part(monkeypatch, engine, tiles, call):
    """(rows of the largest part, rows of all) that a query's kernel gives of one tile."""
    held = {}
    monkeypatch.setattr(sim, engine, lambda *_, parts=sim.grid, **__: held.update(kernel=_[-2], parts=parts) or MagicMock())
    call()
    sizes = [t.num_rows for t in held["kernel"](held["parts"](*tiles))]
    return max(sizes), sum(sizes)


def test_listed_pairs_leave_a_tile_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    tile = np.arange(1500), rng.integers(0, 3, 1500), rng.standard_normal((1500, 4))
    for within in (False, True):
        most, total = largest_part(monkeypatch, "over_tiles", (tile, tile), lambda w=within: sim.all_scores(None, within=w))
        assert total == 1500 * 1499 // 2 and most <= sim.LISTED * sim.WIDE


def test_probes_and_gallery_leave_a_tile_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    probes, gallery = ((np.arange(n), rng.integers(0, 3, n), rng.standard_normal((n, 4))) for n in (700, 5000))
    most, total = largest_part(monkeypatch, "over_sides", (probes, gallery), lambda: sim.side_scores(None, None))
    assert total == 700 * 5000 and most <= sim.LISTED * sim.WIDE


def test_pairs_of_a_large_label_leave_a_tile_in_parts(spark, sf_dir, monkeypatch):
    from tessera.plans import QUERIES

    tile = np.arange(1500), np.zeros(1500, np.int64), np.random.default_rng(7).standard_normal((1500, 4))
    most, total = largest_part(monkeypatch, "over_tiles", (tile, tile), lambda: QUERIES["join_same_label"](spark, sf_dir))
    assert total == 1500 * 1499 // 2 and most <= sim.LISTED * sim.WIDE


def test_a_task_holds_a_large_tile_of_a_label_once(spark, sf_dir, monkeypatch):
    """Beside the vectors of both sides as they travel, a task of join_same_label holds less than 48 MB when its first pairs leave."""
    from tessera.plans import QUERIES

    n, width, held = 60_000, 64, {}
    monkeypatch.setattr(sim, "over_tiles", lambda *_, parts=sim.slabs, **__: held.update(how=(_[-2], _[-1], parts)) or MagicMock())
    QUERIES["join_same_label"](spark, sf_dir)
    frame = MagicMock()
    kernel, schema, parts = held["how"]
    sim.dealt(frame, frame, ["label", "lo", "hi"], kernel, schema, parts)
    run = frame.select.return_value.union.return_value.groupBy.return_value.applyInArrow.call_args.args[0]
    rng = np.random.default_rng(8)

    def batches():
        for at in range(0, 2 * n, 10_000):
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, 10_001 * width, width, dtype=np.int32)), pa.array(rng.random(10_000 * width, np.float32)))
            yield pa.RecordBatch.from_pydict({"label": np.zeros(10_000, np.int64), "id": np.arange(at, at + 10_000), "v": v, "side": np.full(10_000, at >= n)})

    before = pa.total_allocated_bytes()
    tracemalloc.start()
    made = run(batches())
    got = [next(made).num_rows for _ in range(3)]
    arrow, most = pa.total_allocated_bytes() - before, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [sim.LISTED * sim.WIDE] * 3
    assert arrow + most < 2 * n * width * 4 + (48 << 20)


def tile_kernel(monkeypatch, call):
    """The kernel of a query on one tile, as over_tiles would run it."""
    held = {}
    monkeypatch.setattr(sim, "over_tiles", lambda *_, parts=sim.slabs, **__: held.update(kernel=_[-2], parts=parts) or MagicMock())
    call()
    monkeypatch.undo()
    return lambda *tiles: held["kernel"](held["parts"](*tiles))


@pytest.mark.parametrize("kind", ["random", "tenths", "copies", "wild", "ids twice"])
@pytest.mark.parametrize("how", [{}, {"inside_of": 100}, {"low": 0.2, "bins": 4000, "only_inside": True}, {"low": -20, "high": -3, "bins": 7}])
def test_bins_of_a_tile_equal_single_scores(spark, monkeypatch, kind, how):
    rng = np.random.default_rng(9)
    n = 1050
    x = {"tenths": rng.integers(-3, 4, (n, 4)) / 10, "wild": rng.standard_normal((n, 6)) * 4}.get(kind, rng.standard_normal((n, 8)))
    x = x if kind in ("tenths", "wild") else x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.repeat(x[: n // 7], 7, axis=0) if kind == "copies" else x
    labels = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 5, n))
    ids = np.arange(n) // 2 if kind == "ids twice" else np.arange(n)
    tile = ids, labels, x
    made = tile_kernel(monkeypatch, lambda: sim.histogram(None, **how))
    for other in (tile, (ids[:500] + n, labels[:500], x[-500:])):
        _, _, same, s = (np.concatenate(c) for c in zip(*sim.slabs(tile, other), strict=True))
        at = sim.binned(s, **how)
        pos, neg = (np.bincount(at[own & (at >= 0)], minlength=4000) for own in (same, ~same))
        want = [(b, int(pos[b]), int(neg[b])) for b in np.flatnonzero(pos + neg).tolist()]
        assert [tuple(r.values()) for r in made(tile, other).to_pylist()] == want


def test_a_histogram_holds_small_slabs(spark, monkeypatch):
    """Slabs beyond a core's cache took most of the time; ids of pairs are not made."""
    rng = np.random.default_rng(10)
    tile = np.arange(5000), rng.integers(0, 8, 5000), rng.random((5000, 16)) / 4
    made = tile_kernel(monkeypatch, lambda: sim.histogram(None))
    tracemalloc.start()
    t = made(tile, tile)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(t["pos"].to_pylist()) + sum(t["neg"].to_pylist()) == 5000 * 4999 // 2 and most < 32 << 20


def densities(x, least, radius):
    """Clusters of one label by walking from each core in turn."""
    out, near = np.full(len(x), -1), np.round(x @ x.T, 9) >= radius
    core = (near.sum(axis=1) >= least) & (len(x) > least)
    for i in np.flatnonzero(core):
        todo = [i] if out[i] < 0 else []
        number = out.max() + 1
        while todo:
            k = todo.pop()
            out[k] = number
            fresh = np.flatnonzero(near[k] & (out < 0)) if core[k] else []
            out[fresh] = number
            todo.extend(fresh)
    return out


@pytest.mark.parametrize(("block_rows", "radius"), [(None, 0.9), (20, 0.9), (20, 0.93)])
def test_density_clusters_from_tiles(spark, monkeypatch, block_rows, radius):
    """Equal to a walk over each label's whole matrix, which no task makes any more; blocks of 20 rows split the labels."""
    own = sim.block_size
    monkeypatch.setattr(sim, "block_size", lambda rows, v, _: (own(rows, v, None)[0], block_rows or own(rows, v, None)[1]))
    assert not hasattr(graph, "density")
    rng = np.random.default_rng(12)
    labels = np.where(rng.random(240) < 0.7, 0, rng.integers(1, 40, 240))
    x = rng.standard_normal((240, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3] = 0
    rows = collection(spark, x, labels).select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = {r.id: (r.label, r.cluster) for r in graph.clusters(rows, 4, radius).collect()}
    want = {}
    for l in np.unique(labels):
        at = np.flatnonzero(labels == l)
        want |= {int(i): (int(l), int(c)) for i, c in zip(at, densities(x[at], 4, radius), strict=True)}
    assert got == want and len({c for _, c in want.values()}) > 2


@pytest.mark.parametrize("name", ["agg_hist_merge", "sim_v4", "sim_v6", "topk_merge"])
def test_small_tiles_do_not_multiply_rows(spark, tmp_path, monkeypatch, name):
    """A row travels at most once for each of a bounded number of blocks and once more, whatever the size of the table; blocks are about even, also where one label has most rows."""
    from tessera.plans import QUERIES

    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 8))
    x[:2400, 0] = 9
    rows = collection(spark, x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(3000))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    held, own = {}, sim.dealt
    monkeypatch.setattr(sim, "dealt", lambda left, right, *how: held.update(left=left, right=right) or own(left, right, *how))
    QUERIES[name](spark, str(tmp_path))
    assert held["left"].count() + held["right"].count() <= 3000 * (sim.MOST_BLOCKS + 1)
    largest = held["left"].groupBy("lo", "hi").count().agg(F.max("count")).first()[0]
    assert largest <= 1.3 * 3000 / sim.MOST_BLOCKS


@pytest.mark.parametrize("name", ["agg_tpir_hist", "eval_identification"])
def test_pairs_of_a_histogram_are_scored_once(spark, sf_dir, name):
    """The plan read the histogram, and so scored all pairs, four times."""
    from tessera.plans import QUERIES

    assert QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") <= 1


@pytest.mark.parametrize("block_rows", [6, 1000])
def test_best_of_sides(spark, block_rows):
    """Ranks up to k and the best of the own label equal brute force, ties included."""
    rng = np.random.default_rng(3)
    x, labels = rng.integers(-1, 2, (60, 3)), rng.integers(0, 5, 60)
    rows = collection(spark, x, labels)
    k, got = 4, {}
    for r in sim.best_of_sides(rows.where("vec_id < 20"), rows.where("vec_id >= 20"), k, block_rows=block_rows).collect():
        got.setdefault(r.probe, []).append((-r.score, r.gallery, r.same, r["rank"]))
    for p in range(20):
        full = sorted((-float(x[p] @ x[g]), g, bool(labels[p] == labels[g])) for g in range(20, 60))
        mine = sorted(got[p], key=lambda r: r[3])
        assert [r[:3] for r in mine[:k]] == full[:k] and [r[3] for r in mine[:k]] == list(range(1, k + 1))
        assert min((r[:2] for r in mine if r[2]), default=None) == min((r[:2] for r in full if r[2]), default=None)


def test_threshold_by_rank(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.standard_normal(300), np.full(200, 0.25), [7.0, -9.0]])
    scores = spark.createDataFrame([(float(v),) for v in values], "score double")
    ranks = spark.createDataFrame([(r,) for r in (0, 1, 2, 100, 250, 400, 502, 9999)], "r long")
    want = np.sort(values)[::-1]
    for bins in (1, 10, 1 << 16):
        got = {r.r: r.threshold for r in points.threshold_by_rank(scores, ranks, "r", bins).collect()}
        assert got == {r: want[min(r, 502) - 1] for r in (1, 2, 100, 250, 400, 502, 9999)}
    assert points.threshold_by_rank(scores.where("score > 99"), ranks, "r").count() == 0
    assert points.threshold_by_rank(spark.createDataFrame([(3.0,)] * 3, "score double"), ranks, "r").select("threshold").distinct().collect() == [(3.0,)]


def test_tiles_equal_a_native_join(spark, sf_dir):
    e = base.vectors(spark, sf_dir).where("label in (1, 2)")
    native = e.alias("a").join(e.alias("b"), F.col("a.vec_id") < F.col("b.vec_id")).select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.round(dot("a.v", "b.v"), 9).alias("s"))
    tiled = sim.all_scores(e.select("vec_id", "label", F.col("v").alias("embedding")), block_rows=20)
    joined = native.join(tiled, ["i", "j"], "full_outer")
    assert joined.where("s is null or score is null or abs(s - score) > 2e-9").count() == 0


@pytest.mark.parametrize(("vectors", "labels"), [([], []), ([[1, 0]], [0]), ([[1, 0], [1, 0]], [0, 0]), ([[1, 0], [0, 0]], [0, 1])])
def test_small_collections(spark, vectors, labels):
    rows = collection(spark, vectors, labels)
    n = len(vectors)
    assert sim.all_scores(rows).count() == n * (n - 1) // 2
    assert sim.extremes(rows, 5, True, True).count() <= 5
    out = points.tpir_from_hist(sim.histogram(rows), [0.1]).collect()
    assert len(out) == 1


def test_no_negatives_and_no_positives(spark):
    same = points.tpir_from_hist(sim.histogram(collection(spark, np.eye(4), [1, 1, 1, 1])), [0.1]).first()
    other = points.tpir_from_hist(sim.histogram(collection(spark, np.eye(4), [1, 2, 3, 4])), [0.1]).first()
    assert same.tpir == 1.0 and other.tpir == 0.0


def test_ties_go_to_smaller_ids(spark):
    rows = collection(spark, [[1, 0]] * 6, [0, 1, 2, 3, 4, 5])
    got = [(r.i, r.j) for r in sim.extremes(rows, 4, False, True, block_rows=2).collect()]
    assert got == [(0, 1), (0, 2), (0, 3), (0, 4)]


@pytest.mark.parametrize(("n", "folds"), [(10, 3), (257, 10), (9, 10), (20, 10)])
def test_folds_like_ntile(spark, n, folds):
    rows = spark.range(n).select(F.col("id"), base.fold_of(F.col("id"), F.lit(n), folds).alias("f"), F.expr(f"ntile({folds}) over (order by id)").alias("t"))
    assert rows.where("f <> t").count() == 0


def test_running_totals(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("x"))
    for down in (False, True):
        got = {r.k: r.cum_x for r in points.running(rows, "k", ["x"], descending=down).collect()}
        total, order = 0, sorted(rows.collect(), key=lambda r: r.k, reverse=down)
        for r in order:
            total += r.x
            assert got[r.k] == total


def test_numbers_are_dense(spark):
    rows = spark.range(777).select((F.col("id") * 31 % 1009).alias("k"))
    got = sampling.numbered(rows, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(777))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, spark.range(0, 200, 50).select(F.col("id").alias("node"))).collect()}
    assert got == {0: 0, 50: 0, 100: 100, 150: 150}


def test_spanning_tree():
    import pandas as pd

    edges = pd.DataFrame({"i": [0, 0, 1, 2], "j": [1, 2, 2, 3], "w": [1.0, 1.0, 1.0, 5.0]})
    assert list(graph.spanning_tree(edges)[["i", "j"]].itertuples(index=False, name=None)) == [(0, 1), (0, 2), (2, 3)]


def test_waits(spark):
    rows = spark.createDataFrame([(0, s, float(v)) for s, v in enumerate([1, 2, 2, 1, 3, 3])], "run long, step long, m double")
    got = history.waits(rows, "run", "step", "m").orderBy("step").collect()
    assert [r.improved for r in got] == [True, True, False, False, True, False] and [r.waited for r in got] == [0, 0, 1, 2, 0, 1]


def test_ema_is_the_recurrence(spark):
    values = [3.0, -1.0, 4.0, 1.0, 5.0]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "run long, step long, m double")
    m = values[0]
    for v in values[1:]:
        m = 0.1 * v + 0.9 * m
    assert abs(history.ema(rows, "run", "step", "m", 0.1).first().ema - m) < 1e-12


MAGIC = struct.pack("<I", recordio.MAGIC)


@pytest.mark.parametrize("payload", [b"", b"a", b"abcd", MAGIC, b"ab" + MAGIC, b"abcd" + MAGIC * 2 + b"xy"])
def test_records(payload):
    data = recordio.write_record(payload)
    assert len(data) % 4 == 0 and recordio.read_record(memoryview(data + b"more"), 0) == (payload, len(data))


def test_corrupt_records():
    data = recordio.write_record(b"hello")
    for bad in (data[:7], data[:-4], b"\x00" * 16):
        with pytest.raises(recordio.CorruptRecord):
            recordio.read_record(memoryview(bad), 0)


def test_recordio_source(spark, tmp_path):
    files.register(spark)
    rows = [(i, 0 if i % 3 else 2, float(i), None if i % 3 else [1.0, float(i)], i, 7, (MAGIC + b"x" * (i % 50))) for i in range(300)]
    df = spark.createDataFrame(rows, recordio.SCHEMA).repartition(3)
    df.write.format("recordio").mode("append").save(str(tmp_path / "r"))
    got = {r.idx: r for r in spark.read.format("recordio").option("recordsPerPartition", "37").load(str(tmp_path / "r")).collect()}
    assert len(got) == 300
    for idx, flag, label, labels, first, second, payload in rows:
        r = got[idx]
        assert (r.flag, r.labels, r.id, r.id2, bytes(r.payload)) == (flag, labels or [], first, second, payload)
        assert r.label == (0.0 if labels else label)
    for f in os.listdir(tmp_path / "r"):
        if f.endswith(".idx"):
            os.remove(tmp_path / "r" / f)
    assert spark.read.format("recordio").load(str(tmp_path / "r")).count() == 300


def test_kinds():
    assert [files.kind_of(n) for n in (["data.mdb"], ["a.rec", "a.idx"], ["x.tar"], ["a.arrow"], ["class1"])] == ["lmdb", "recordio", "tar", "arrow", "folder"]
    assert files.kind_of([], True) == "synthetic"
    with pytest.raises(FileNotFoundError):
        files.kind_of([])


def test_folder_cache_and_json(spark, tmp_path):
    for c in ("b", "a"):
        (tmp_path / "root" / c).mkdir(parents=True)
        (tmp_path / "root" / c / "1.jpg").write_bytes(c.encode())
    got = files.folder_cached(spark, str(tmp_path / "root"), str(tmp_path / "cache")).collect()
    assert sorted((r.path[-7:], r.label) for r in got) == [("a/1.jpg"[-7:], 0), ("b/1.jpg"[-7:], 1)]
    assert files.folder_cached(spark, "nowhere", str(tmp_path / "cache")).count() == 2
    files.write_json(spark, str(tmp_path / "x.json"), {"a": 1})
    files.write_json(spark, str(tmp_path / "x.json"), {"a": 2})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 2}


def test_missing_libraries():
    with pytest.raises(NotImplementedError):
        files.optional("hdf5")


def test_synthetic_data_follows_its_seed(spark):
    a, b, c = (files.replicas(spark, 5, 3, 8, 0.1, seed=s).orderBy("key", "image").collect() for s in (1, 1, 2))
    assert a == b != c and len(a) == 15


def events_stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_streams_equal_batches(spark, sf_dir, tmp_path, kind):
    rows, stream = events_stream(spark, sf_dir, tmp_path)
    window = getattr(windows, kind)
    late = "3650 days"  # nothing is dropped, whatever the order of the files
    q = window(stream, late=late).writeStream.outputMode("complete" if kind != "sessions" else "complete").format("memory").queryName(f"out_{kind}").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table(f"out_{kind}").collect())) == sorted(map(tuple, window(rows).collect()))
    finally:
        q.stop()


def test_ring_stream(spark, tmp_path):
    spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("x")).coalesce(1).write.option("maxRecordsPerFile", 11).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, i long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = queue.ring(stream, "k", "i", "x", 5).writeStream.outputMode("append").format("memory").queryName("ring").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        held = {}
        for r in spark.table("ring").collect():
            held[r.key, r.slot] = max(held.get((r.key, r.slot), -1), r["index"])
        assert held == {(k, s): max(i for n, i in enumerate(range(k, 40, 2)) if n % 5 == s) for k in (0, 1) for s in range(5)}
    finally:
        q.stop()


def test_projection_reads_two_columns(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", doubles("embedding").alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1]


def test_mixture_equals_the_unbinned_fit(spark):
    """The rounds over bins against the same rounds over all values, and rows without a spread."""
    from tessera.operators.graph import mixture

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.3, 400), rng.uniform(-4, 4, 500)])
    z = np.round((x - x.mean()) / x.std(), 3)
    share, level, var, before = 0.1, 0.2, (z * z).mean(), 0.0
    for _ in range(1000):
        phi = np.exp(-z * z / 2 / (var + 1e-3)) / np.sqrt(2 * np.pi * (var + 1e-3))
        g = phi * share / (phi * share + (1 - share) * level)
        var, share = (g * z * z).sum() / g.sum(), min(g.mean(), 0.5)
        w = (1 - g) / (1 - share + 1e-10) / g.sum()
        spread = 3 * (w * z * z).sum() - (w * z).sum() ** 2
        level = 0.001 if abs(spread) < 0.001 else 1 / (2 * np.sqrt(spread) + 1e-10)
        like = (share * phi + (1 - share) * level).sum()
        if abs(like - before) < 1e-10:
            break
        before = like
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got, share_, var_, _ = mixture(df, "v")
    assert abs(share_ - share) < 1e-6 and abs(var_ - var) < 1e-6
    assert max(abs(a - b) for a, b in zip(sorted(r.posterior for r in got.collect()), sorted(g.tolist()), strict=True)) < 5e-3
    assert {r.posterior for r in mixture(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v")[0].collect()} == {None}


@pytest.mark.parametrize("ids", [range(300), range(0, 3 * sampling.M, sampling.M // 40), range(0, 90 * sampling.M, sampling.M), range(-50, 200)])
@pytest.mark.parametrize("k", [1, 40, 10**6])
def test_least_keys_equal_all_pairs(ids, k, monkeypatch):
    monkeypatch.setattr(sampling, "CANDIDATES", 500)
    rng = np.random.default_rng(k)
    ids = rng.permutation(np.array(ids, np.int64))
    key = lambda i, j: int(np.fmod(i * sampling.A + j * sampling.B, sampling.M))
    for a, b, own in ((ids, ids, True), (ids[::2], ids[1::2], False), (ids[:1], ids[1:], False), (ids[:0], ids, False)):
        every = {(min(i, j), max(i, j)) for i in a.tolist() for j in b.tolist() if i != j}
        want = sorted((key(i, j), i, j) for i, j in every)[:k]
        assert sorted((key(i, j), i, j) for i, j in zip(*(x.tolist() for x in sampling.least_keys(a, b, k, own)), strict=True)) == want


def test_positive_pairs_of_a_large_class_are_not_all_made():
    """A class of 200,000 rows has 2 * 10**10 pairs, which nothing can list here."""
    i, j = sampling.least_keys(np.arange(200_000), np.arange(200_000), 1760, True)
    assert len(i) == 1760 and (i < j).all() and np.fmod(i * sampling.A + j * sampling.B, sampling.M).max() < 10


@pytest.mark.parametrize("block", [16, 1000])
def test_positive_pairs_of_tiles(spark, block, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", block)
    monkeypatch.setattr(sampling, "SMALL", 5)
    labels = [0] * 70 + [1] * 40 + [2] * 4 + [3, None]
    rows = spark.createDataFrame(list(enumerate(labels)), "vec_id long, label int")
    got = {}
    for r in sampling.positive_pairs(rows, "vec_id", "label").collect():
        got.setdefault(r.label, set()).add((r.i, r.j))
    key = lambda p: ((p[0] * sampling.A + p[1] * sampling.B) % sampling.M, p)
    for label, cap in ((0, 612), (1, 532), (2, 200)):
        own = [i for i, x in enumerate(labels) if x == label]
        assert got.pop(label) == set(sorted(((i, j) for i in own for j in own if i < j), key=key)[:cap])
    assert not got


@pytest.mark.parametrize("ids", [np.arange(300), np.array([5]), np.array([3, 3]), np.arange(40) * sampling.M + 7, np.arange(-30, 60), np.arange(50) * 20_011])
def test_least_partner_equals_all_pairs(ids):
    key = lambda i, j: int(np.fmod(i * sampling.A + j * sampling.B, sampling.M))
    for a, b in ((ids, ids), (ids[::2], ids[1::2]), (ids[:7], ids)):
        want = sorted((i, *min((key(i, j), j) for j in b.tolist() if j != i)) for i in a.tolist() if any(j != i for j in b.tolist()))
        assert sorted(zip(*(x.tolist() for x in sampling.least_partner(a, b)), strict=True)) == want


def test_partners_of_a_large_label_are_not_all_tried():
    """A label of 200,000 rows has 4 x 10^10 pairs, which were joined."""
    i, _, j = sampling.least_partner(np.arange(200_000), np.arange(200_000))
    assert len(i) == 200_000 and (i != j).all()


@pytest.mark.parametrize("name", ["sim_extremes", "agg_fa_counts"])
def test_no_pairs_are_listed_for_few_rows(spark, sf_dir, name):
    """sim_extremes scored all pairs for each of its sides; agg_fa_counts passed a tenth of them on, one by one."""
    from tessera.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == {"sim_extremes": 1, "agg_fa_counts": 2}[name] and ("threshold" in plan or name == "sim_extremes")


def test_counts_and_extremes_of_a_tile_equal_single_scores(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x, labels = rng.integers(-3, 4, (700, 4)) / 10, np.where(rng.random(700) < 0.1, np.nan, rng.integers(0, 5, 700))
    tile = np.arange(700), labels, x
    i, j, same, s = (np.concatenate(c) for c in zip(*sim.slabs(tile, tile), strict=True))
    got = tile_kernel(monkeypatch, lambda: sim.counts_from(None, [0.1, 0.16]))(tile, tile).to_pylist()
    assert got == [{"threshold": t, "pos": int((same & (s >= t)).sum()), "neg": int((~same & (s >= t)).sum())} for t in (0.1, 0.16)]
    for k, (own, highest) in ((40, (True, True)), (7, (False, False)), (40, (None, True))):
        made = sim.best_of_tile(tile, tile, k, [(own, highest)]).drop_columns("want").to_pylist()
        want = sorted((-c if highest else c, a, b) for a, b, e, c in zip(i.tolist(), j.tolist(), same.tolist(), s.tolist(), strict=True) if own is None or e == own)[:k]
        assert [(-r["score"] if highest else r["score"], r["i"], r["j"]) for r in made] == want


def test_mined_pairs_are_verified_in_their_tiles(spark, sf_dir, monkeypatch):
    """Pairs were joined to the vectors of both ends, which shuffled two vectors a pair. Wrong labels and scores are still seen."""
    from tessera.plans import QUERIES

    assert "Join" not in QUERIES["sim_pair_verify"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    every = lambda i, j: i >= 0
    rows = collection(spark, [[1, 0], [1, 0], [0, 1], [0.6, 0.8]], [0, 1, 1, 1])
    label_of = lambda v: v.argmax(axis=1)
    assert tuple(sim.verified(rows, 0.5, every, label_of).first()) == (4, 0, 2)
    assert tuple(sim.verified(rows, 0.5, every, label_of, tolerance=-1).first()) == (4, 4, 2)
    assert tuple(sim.verified(rows.where("vec_id > 9"), 0.5, every, label_of).first()) == (0, 0, 0)
