"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

BITS, SEED = 64, 42


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The SimHash of one text: a bit is 1 if it is 1 in over half of the shingles' hashes."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(body[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): one row per row of docs; h is a hash of the text. Null texts count as empty; a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "h", "fp"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text")).mapInArrow(tidy(run), "doc_id long, h long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks that keep all but `distance` of the blocks: of two fingerprints that differ in no more bits, one mask at least sees them equal."""
    width = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    at = np.concatenate([[0], np.cumsum(width)])
    each = [((1 << width[i]) - 1) << int(at[i]) for i in range(blocks)]
    return [sum(each[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, full_bucket: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all pairs at `distance` or fewer differing bits.

    A bucket holds the fingerprints that agree on all but `distance` of the blocks. Buckets of up to `full_bucket`
    members are compared pair by pair. In a fuller bucket each member is sent to itself and to each neighbour at one bit
    in the free blocks: members at distance 2 meet at the one between them, so a star around the least member of
    each meeting point has the same components as all pairs, with rows in proportion to the members. That serves distance 2
    alone: at any other, all buckets are compared pair by pair.
    """
    blocks = max(blocks, distance + 1)
    masks = block_masks(blocks, distance)
    keyed = F.inline(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket"), F.col("fp")) for i, m in enumerate(masks))))
    rows = fps.select(keyed)
    counts = rows.groupBy("mask", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(rows.join(counts, ["mask", "bucket"]))
    few = (shared.where(F.col("members") <= full_bucket) if distance == 2 else shared).drop("members")
    pairs = few.alias("x").join(few.select("mask", "bucket", F.col("fp").alias("other")).alias("y"), ["mask", "bucket"])
    pairs = pairs.where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if distance != 2:
        return pairs.distinct()
    free = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks)), F.col("mask") + 1)
    meet = shared.where(F.col("members") > full_bucket).select("fp", F.explode(free).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    least = meet.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = meet.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches, by alternating large and small stars.

    Raises if `most_rounds` do not suffice; the number needed grows with the logarithm of the longest path.
    """
    now, seen = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()), None
    for _ in range(most_rounds):
        # Large star: each node's greater neighbours go to its least neighbour, or to itself.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v"), F.col("m").alias("u")).distinct()
        # Small star: each node and its smaller neighbours go to the least of them.
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").union(down.select("v", F.col("m").alias("u"))).distinct()
        now = cut(small)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = sign
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, distance: int = 2, blocks: int = 4, full_bucket: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, h (a hash of its text), fp (long), root (which names its component) and component_id, the least doc_id that links of `distance` bits reach.

    Null and empty texts have fingerprint 0 and link like others. A null doc_id is no candidate for the least one; a
    component of such rows alone has component_id null. Equal rows each come out. An empty table gives no rows.
    """
    each = cut(fingerprints(docs, text, id_col, shingle))
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(classes.select("fp"), distance, blocks, full_bucket))
    members = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = members.join(members.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return each.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def representatives(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row of docs for each component, with its columns: the one of the least doc_id (null ids last), then of the least text hash."""
    found = near_duplicates(docs, text, id_col, **how)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    chosen = found.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h"))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"))
    # The join has dealt rows by id and hash, so that of equal rows one stays without a further shuffle.
    return rows.join(chosen, rows.id.eqNullSafe(chosen._id) & (rows.h == chosen._h), "left_semi").dropDuplicates(["id", "h"]).select("_row.*")


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
