"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Positions on the ring are 60-bit numbers: the first 15 hexadecimal digits of an MD5.
RING_BITS = 60


def position(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted((position(f"shard-{s}-node-{v}"), s) for s in range(shards) for v in range(virtual))


def flows(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, ranks, shard, first slot).

    Shards have room for equal counts, the first ones for one more if the keys don't divide. In round r each arc offers the
    keys it has left, in order, to the shard r virtual nodes clockwise; those that find no room go on. As many keys as
    room: at the end every shard is full, so counts are at most one apart.
    """
    total, arcs = sum(counts.values()), len(owners)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, done, out = [0] * shards, dict.fromkeys(counts, 0), []
    waiting = sorted(a for a, n in counts.items() if n)
    for hop in range(arcs):
        if not waiting:
            break
        still = []
        for arc in waiting:
            shard = owners[(arc + hop) % arcs]
            take = min(counts[arc] - done[arc], room[shard] - used[shard])
            if take:
                out.append((arc, done[arc], take, shard, used[shard]))
                done[arc] += take
                used[shard] += take
            if done[arc] < counts[arc]:
                still.append(arc)
        waiting = still
    if waiting:
        raise RuntimeError("keys are left though all arcs were offered")
    return out


def assign(docs: DataFrame, shards: int = 40, virtual: int = 64, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law 'rows', shard, slot (gapless from 0 in each shard), grown_shard null.

    A key's point on the ring comes from its doc_id, or from its text if that is null. An arc ends at the virtual node that owns it.
    Only counts of arcs, of which there are shards * virtual, come to the driver; ranks within an arc are found arc by arc.
    Null texts are empty: size 16, checksum 0. Equal rows each get a slot of their own. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    nodes = ring(shards, virtual)
    ends, owners = [p for p, _ in nodes], [s for _, s in nodes]
    point = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), body)).cast("binary")), 1, 15), 16, 10).cast("long")
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), point.alias("point"))
    # Arcs by a table of the ring's cells: within a cell, the ends that lie in it decide.
    cell_bits = max(1, (shards * virtual).bit_length())
    width = 1 << (RING_BITS - cell_bits)
    cells = [[bisect_left(ends, c * width), [e for e in ends[bisect_left(ends, c * width) : bisect_left(ends, (c + 1) * width)]]] for c in range(1 << cell_bits)]
    spark = docs.sparkSession
    by_cell = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"cell": c, "base": b, "inner": i} for c, (b, i) in enumerate(cells)])), "array<struct<cell:long,base:int,inner:array<long>>>")))
    placed = each.withColumn("cell", F.shiftright("point", RING_BITS - cell_bits)).join(F.broadcast(by_cell), "cell")
    arc = F.pmod(F.col("base") + F.size(F.filter("inner", lambda e: e < F.col("point"))), F.lit(len(nodes)))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "point", arc.alias("arc")))
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    plan = flows(counts, owners, shards)
    by_arc: dict[int, list[dict]] = {}
    for a, first, n, shard, slot in plan:
        by_arc.setdefault(a, []).append({"first": first, "n": n, "shard": shard, "slot": slot})
    moves = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"arc": a, "moves": m} for a, m in by_arc.items()])), "array<struct<arc:int,moves:array<struct<first:long,n:long,shard:int,slot:long>>>>")))
    ranked = placed.withColumn("rank", F.expr("row_number() over (partition by arc order by point, doc_id, text_crc32, size) - 1").cast("long"))
    found = ranked.join(F.broadcast(moves), "arc").withColumn("move", F.filter("moves", lambda m: (F.col("rank") >= m["first"]) & (F.col("rank") < m["first"] + m["n"]))[0])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("move.shard").alias("shard"), (F.col("move.slot") + F.col("rank") - F.col("move.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
