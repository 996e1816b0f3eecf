"""Passages that recur: confirmed on distinct surroundings, compiled into sharded Aho-Corasick automata, located in all documents.

Confirming. A window of `window` words that stands at two places is found at both by one anchor: the phrase of ANCHOR
words with the least hash in it, so each window belongs to one anchor. Anchors that stand once are done. Of the others, equal surroundings are
counted once. The windows around an anchor are taken in ranges of STEP offsets, which all hold the same core of words: a
core that stands once holds no recurring window, and one whose windows are the same everywhere holds recurring ones only.
The windows of all other cores are counted one by one. Every count is a partial aggregation, so no group meets in a task.

Locating. Each recurring window has one representative place; the representative windows of a text that follow
each other are a passage. Documents are dealt to shards, a shard is sent the passages that a class of its surroundings
met, and all its documents are streamed through the automaton of these. The automaton holds tiles of a passage, one of which lies whole in
each of its windows; a hit is extended along the passage, and extents of a window or more are spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, SPACE, WORD_BASE, Spans, cut, drop, few, mixed, runs, slices, tidy, word_hashes

#: Words of an anchor, and offsets of windows that share a core.
ANCHOR, STEP = 8, 7
#: Windows of one passage at most; recurring anchors, and bytes of compressed text, in the documents of a shard on average.
BLOCK, SHARD, SHARD_BYTES = 128, 50_000, 2 << 20
#: Anchors that hold more than one in HOT of all occurrences each, so HOT at most, are broadcast.
HOT = 2000
#: Partitions of documents at most; a partition may hold many shards, one after the other.
MOST_PARTITIONS = 20_000
#: Passages up to which a tile finds them itself; those of a tile with more are found by whole windows, which have one passage each.
MOST_SHARED = 8
PLACE = np.uint64((1 << 30) - 1)
OCCURRENCE = "anchor long, around long, id long, h long, pos int, low int, high int"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i + width] for each i that has so many."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(phrase: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of an anchor, first and last window that it is the anchor of), in order; phrase: hashes of all phrases.

    The anchor of a window is its phrase with the least upper bits of the hash, the first of equal ones: a function of its words alone.
    """
    none = np.zeros(0, np.int64)
    if len(doc) < window:
        return none, none, none
    n = len(doc) - window + 1
    least = sliding_least((phrase & ~PLACE) | np.arange(len(phrase), dtype=np.uint64), window - ANCHOR + 1)
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(start):
        return none, none, none
    at = (least[start] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])]))
    return at[new], start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """docs: id, h, text. One row per anchor: hashes of it and of the words around it, the number of its first word, and the least and greatest offset to it of its windows."""
    reach = window - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                starts, ends, doc = runs(~SPACE[data], offsets)
                if len(starts) < window:
                    continue
                spans = Spans(word_hashes(data, starts, ends), WORD_BASE)
                begin = np.arange(len(doc) - ANCHOR + 1)
                phrase = mixed(spans(begin, begin + ANCHOR))
                at, low, high = anchors(phrase, doc, window)
                first = np.searchsorted(doc, np.arange(rows.num_rows))[doc[at]]
                last = np.searchsorted(doc, np.arange(rows.num_rows), "right")[doc[at]]
                lo, hi = np.maximum(at - reach, first), np.minimum(at + ANCHOR + reach, last)
                around = mixed(mixed(spans(lo, hi)) + ((at - lo) * 4096 + (hi - at)).astype(np.uint64))
                own = pa.array(doc[at])
                small = [pa.array(x.astype(np.int32)) for x in (at - first, at - high, at - low)]
                yield pa.RecordBatch.from_arrays([pa.array(phrase[at].view(np.int64)), pa.array(around.view(np.int64)), rows.column(0).take(own), rows.column(1).take(own), *small], [x.split()[0] for x in OCCURRENCE.split(", ")])

    return docs.select("id", "h", "text").mapInArrow(tidy(run), OCCURRENCE)


def recurring_only(first: DataFrame) -> DataFrame:
    """The occurrences of anchors that stand more than once. Those of over a HOT-th of all, HOT at most, are broadcast, so that no task gets all of one."""
    recurring = cut(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(recurring.where(F.col("n") * HOT > first.count()).select("anchor"))
    rest = first.join(hot, "anchor", "left_anti").join(recurring.select("anchor"), "anchor", "left_semi")
    occ = cut(first.join(hot, "anchor", "left_semi").unionByName(rest))
    drop(recurring)
    return occ


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs: text and others, with the text compressed to z, as it goes through shuffles."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in few(batches, 2048):
            z = pa.array([squeeze.compress(x.as_buffer().to_pybytes()) for x in batch.column(len(names)).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], z], [*names, "z"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(tidy(run), f"{kinds}, z binary")


CORES = "anchor long, around long, n long, id long, h long, pos int, core_a long, core_b long, low int, windows array<bigint>"


def cores(texts: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """One row for each class of surroundings and range of STEP offsets: the core that the range's windows share, their least offset and their hashes.

    texts: id, h, z. classes: anchor, around, n and one place of the class (id, h, pos, low, high). The core's name has 128 bits and tells the range; the hash of a
    window counts beside it. Texts of equal rows come out once each, with classes that recur anyway.
    """
    reach = window - ANCHOR
    wanted = classes.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("anchor", "around", "n", "pos", "low", "high")).alias("found"))

    def rows_of(texts: list[bytes], ids: pa.Array, hs: pa.Array, found: pa.ListArray) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        starts, ends, doc = runs(~SPACE[data], offsets)
        h = word_hashes(data, starts, ends)
        one, two = Spans(h, WORD_BASE), Spans(h, BASE)
        flat = found.flatten()
        anchor, around, n, pos, low, high = (flat.field(i).to_numpy() for i in range(6))
        own = np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy())
        p = np.searchsorted(doc, np.arange(len(texts)))[own] + pos
        for first in range(0, reach + 1, STEP):
            last = min(first + STEP - 1, reach)
            a, b = np.maximum(low, first), np.minimum(high, last)
            k = np.flatnonzero(a <= b)
            if not len(k):
                continue
            at, a, b = p[k], a[k], b[k]
            begin, end = at - first, at - last + window
            name = [mixed(s(begin, end) + np.uint64(first * 64 + last + 1)).view(np.int64) for s in (one, two)]
            each = np.arange(first, last + 1)
            there = (each >= a[:, None]) & (each <= b[:, None])
            begins = (at[:, None] - each)[there]
            windows = mixed(one(begins, begins + window)).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(b - a + 1)]).astype(np.int32)
            take = pa.array(own[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[k]), pa.array(around[k]), pa.array(n[k]), ids.take(take), hs.take(take), pa.array(pos[k]), *map(pa.array, name), pa.array(a.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(windows))],
                [x.split()[0] for x in CORES.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in few(batches, 2048):
            held: list[bytes] = []
            size = begin = 0
            for i, z in enumerate(batch.column(2)):
                held.append(plain.decompress(z.as_buffer()))
                size += len(held[-1]) + 1
                if size > 1 << 21 or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    yield from rows_of(held, part.column(0), part.column(1), part.column(3))
                    held, size, begin = [], 0, i + 1

    joined = texts.join(wanted, (texts.id == wanted.wid) & (texts.h == wanted.wh)).select("id", "h", "z", "found")
    return joined.mapInArrow(tidy(run), CORES)


def confirmed(named: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(passages, met) of recurring windows, from rows of cores().

    passages: (id, h, lo, hi), the representative places of recurring windows, each window once: those that start at the words lo to hi.
    met: (anchor, around, id, h, lo, hi), the representatives of the recurring windows of each class of surroundings.
    """
    named = named.withColumn("whole", F.xxhash64("low", "windows"))
    place = F.struct("id", "h", "pos", "low", F.size("windows").alias("size"))
    core = ["core_a", "core_b"]
    kinds = named.groupBy(*core, "whole").agg(F.sum("n").alias("n"), F.min(place).alias("at"))
    likes = cut(kinds.groupBy(*core).agg(F.sum("n").alias("total"), F.count("*").alias("wholes"), F.min("at").alias("at")).where("total > 1").drop("total"))
    found = cut(named.drop("whole").join(likes, core))
    ends = [F.col("at.id").alias("id"), F.col("at.h").alias("h"), (F.col("at.pos") - F.col("at.low") - F.col("at.size") + 1).alias("lo"), (F.col("at.pos") - F.col("at.low")).alias("hi")]
    each = found.where("wholes > 1").select("anchor", "around", "n", "id", "h", "pos", "low", *core, F.posexplode("windows").alias("o", "name")).withColumn("start", F.col("pos") - F.col("low") - F.col("o")).withColumn("o", F.col("low") + F.col("o"))
    names = cut(each.groupBy(*core, "o", "name").agg(F.sum("n").alias("n"), F.min(F.struct("id", "h", "start")).alias("at")).where("n > 1").drop("n"))
    one = [F.col("at.id").alias("id"), F.col("at.h").alias("h"), F.col("at.start").alias("lo"), F.col("at.start").alias("hi")]
    passages = likes.where("wholes = 1").select(*ends).unionByName(names.select(*one))
    met = found.where("wholes = 1").select("anchor", "around", *ends).unionByName(each.select("anchor", "around", *core, "o", "name").join(names, [*core, "o", "name"]).select("anchor", "around", *one))
    return passages, met


def in_blocks(spans: DataFrame) -> DataFrame:
    """Rows with spans lo to hi, which have fewer windows than a block, cut at the ends of blocks, with their block."""
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    both = spans.withColumn("block", F.explode(F.array_distinct(F.array(block("lo"), block("hi")))))
    return both.withColumn("lo", F.greatest("lo", F.col("block") * BLOCK)).withColumn("hi", F.least("hi", F.col("block") * BLOCK + BLOCK - 1))


PASSAGE = "id long, h long, block int, words binary"


def passage_rows(texts: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(id, h, block, words): the passages of each block of each representative text, words joined by one space, passages by a line feed."""
    spans = in_blocks(passages).groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("block", "lo", "hi")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in few(batches):
            own, blocks, made = [], [], []
            lists = batch.column(3)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            block, lo, hi = (flat.field(i).to_numpy() for i in range(3))
            for i, z in enumerate(batch.column(2)):
                words = plain.decompress(z.as_buffer()).split()
                a, b = bounds[i], bounds[i + 1]
                order = a + np.lexsort((lo[a:b], block[a:b]))
                last = None
                for k, x, y in zip(block[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
                    if last is None or k != last[0] or x > last[2] + 1:
                        if last:
                            own.append(i), blocks.append(last[0]), made.append(b" ".join(words[last[1] : last[2] + window]))
                        last = [k, x, y]
                    else:
                        last[2] = max(last[2], y)
                if last:
                    own.append(i), blocks.append(last[0]), made.append(b" ".join(words[last[1] : last[2] + window]))
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(blocks, pa.int32()), pa.array(made, pa.binary())], [x.split()[0] for x in PASSAGE.split(", ")])

    joined = texts.dropDuplicates(["id", "h"]).join(spans, (F.col("id") == F.col("wid")) & (F.col("h") == F.col("wh"))).select("id", "h", "z", "found")
    return joined.mapInArrow(tidy(run), PASSAGE).groupBy("id", "h", "block").agg(F.array_join(F.collect_list(F.col("words").cast("string")), "\n").cast("binary").alias("words"))


class Passages:
    """The automaton of a shard's passages.

    A word is two letters, the first from an alphabet of its own, so that nodes have few branches and matches begin with a word.
    """

    UNKNOWN = "\x01\x02"

    def __init__(self, window: int):
        self.window, self.tile = window, (window + 1) // 2
        self.codes: dict[bytes, str] = {}
        self.passages: list[str] = []
        self.automaton = None

    def add(self, words: list[bytes]) -> None:
        codes = self.codes
        for w in words:
            if w not in codes:
                codes[w] = chr(0x2000 + len(codes) // 256) + chr(0x100 + len(codes) % 256)
        self.passages.append("".join([codes[w] for w in words]))

    def compile(self) -> None:
        """Tiles begin at every `tile` words of a passage, so that each window holds one; (passage, word) for each."""
        wide, tile = 2 * self.window, 2 * self.tile
        patterns: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.passages):
            for t in range(0, len(p) - tile + 1, tile):
                patterns.setdefault(p[t : t + tile], []).append((k, t))
        for pattern in [x for x, held in patterns.items() if len(held) > MOST_SHARED]:
            for k, t in patterns.pop(pattern):
                p = self.passages[k]
                for y in range(max(0, t + tile - wide), min(t, len(p) - wide) + 1, 2):
                    patterns.setdefault(p[y : y + wide], []).append((k, y))
        self.automaton = ahocorasick.Automaton()
        for pattern, held in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), held))
        if patterns:
            self.automaton.make_automaton()

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans of words that recurring windows cover, in order and apart."""
        if not self.passages or len(words) < self.window:
            return []
        if self.automaton is None:
            self.compile()
        s = "".join(map(self.codes.get, words, repeat(self.UNKNOWN)))
        passages, wide = self.passages, 2 * self.window
        done: dict[tuple[int, int], int] = {}
        found: set[tuple[int, int]] = set()
        for end, (size, held) in self.automaton.iter(s):
            x = end + 1 - size
            for k, t in held:
                if done.get((k, x - t), 0) > x:
                    continue
                p = passages[k]
                lo = x - same_tail(p, t, s, x)
                hi = x + same_head(p, t, s, x)
                done[k, x - t] = hi
                if hi - lo >= wide:
                    found.add((lo // 2, hi // 2))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out


def same_head(p: str, t: int, s: str, x: int) -> int:
    """Letters that p from t on and s from x on begin with alike, in whole words."""
    n = min(len(p) - t, len(s) - x)
    if p[t : t + n] == s[x : x + n]:
        return n
    have = 0
    while have < n:
        more = (have + n + 1) // 2
        if p[t + have : t + more] == s[x + have : x + more]:
            have = more
        else:
            n = more - 1
    return have // 2 * 2


def same_tail(p: str, t: int, s: str, x: int) -> int:
    """Letters that p up to t and s up to x end with alike, in whole words."""
    n = min(t, x)
    if p[t - n : t] == s[x - n : x]:
        return n
    have = 0
    while have < n:
        more = (have + n + 1) // 2
        if p[t - more : t - have] == s[x - more : x - have]:
            have = more
        else:
            n = more - 1
    return have // 2 * 2


def located(texts: DataFrame, delivered: DataFrame, shard: Column, partitions: int, window: int, whole: bool) -> DataFrame:
    """(row, n_words, n_removed, and kept_text if `whole`, else kept_sha256) of texts (id, h, row, z): each shard's passages (shard, words) make its automaton, then all its texts are streamed through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        now, held = None, Passages(window)
        for batch in few(batches):
            own, counts, removed, made = [], [], [], []
            for i, (number, kind, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if number != now:
                    now, held = number, Passages(window)
                if kind == 0:
                    for passage in z.as_buffer().to_pybytes().split(b"\n"):
                        held.add(passage.split(b" "))
                    continue
                raw = plain.decompress(z.as_buffer())
                words = raw.split()
                gone = held.spans(words)
                own.append(i), counts.append(len(words)), removed.append(sum(hi - lo for lo, hi in gone))
                if whole:
                    made.append(stripped(raw, gone) if gone else raw)
                else:
                    for lo, hi in gone[::-1]:
                        del words[lo:hi]
                    made.append(hashlib.sha256(b" ".join(words)).hexdigest())
            last = pa.array(made, pa.binary()).cast(pa.string()) if whole else pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(own, pa.int64())), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), last], ["row", "n_words", "n_removed", "made"])

    kind = texts.schema["row"].dataType.simpleString()
    left = delivered.select("shard", F.lit(0).alias("kind"), F.col("words").alias("z"), F.lit(None).cast(kind).alias("row"))
    right = texts.select(shard.alias("shard"), F.lit(1).alias("kind"), "z", "row")
    ordered = left.unionByName(right).repartition(partitions, "shard").sortWithinPartitions("shard", "kind")
    made = ordered.mapInArrow(tidy(run), f"row {kind}, n_words long, n_removed long, made string")
    return made.withColumnRenamed("made", "kept_text" if whole else "kept_sha256")


def kept_rows(docs: DataFrame, window: int, text: str, id_col: str, carried: Column, whole: bool) -> DataFrame:
    """(row, n_words, n_removed, kept_text or kept_sha256), one per row of docs; row is `carried`."""
    if window < ANCHOR:
        raise ValueError(f"a window of {window} words; {ANCHOR} at least are needed")
    body, number = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(body, number.isNull()).alias("h"), carried.alias("row"), body.alias("text"))
    first = cut(occurrences(rows, window))
    occ = recurring_only(first)
    drop(first)
    texts = cut(packed_texts(rows))
    size = texts.agg(F.sum(F.length("z"))).first()[0] or 0
    shards = max(1, -(-occ.count() // SHARD), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int")
    classes = occ.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "pos", "low", "high")).alias("at")).select("anchor", "around", "n", "at.*")
    named = cut(cores(texts, classes, window))
    passages, met = confirmed(named, window)
    asked = in_blocks(met).select("anchor", "around", "id", "h", "block").distinct()
    ways = asked.join(occ.select("anchor", "around", shard.alias("shard")).distinct(), ["anchor", "around"]).select("id", "h", "block", "shard").distinct()
    ways = cut(ways)
    drop(occ, named)
    delivered = cut(passage_rows(texts, passages, window).join(ways, ["id", "h", "block"]).select("shard", "words"))
    drop(ways)
    return located(texts, delivered, shard, max(1, min(shards // 2, MOST_PARTITIONS)), window, whole)


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null texts count as empty: no words. Windows are judged on the input as it is, so copies of a text lose all their
    words if it has a window at all. Equal rows are copies of each other and each come out. An empty table gives no rows.
    """
    found = kept_rows(docs, window, text, id_col, F.struct(F.col(id_col).cast("long").alias("doc_id")), False)
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def replaced(docs: DataFrame, window: int = 35, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each text less its removed words and the white space after each span; a text that loses none stays as it is, null texts become empty."""
    others = [c for c in docs.columns if c != text]
    found = kept_rows(docs, window, text, id_col, F.struct(*(F.col(c) for c in others)), True)
    return found.select(*(F.col("kept_text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def stripped(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each span."""
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = runs(~SPACE[data], np.array([0, len(data)]))
    bounds = [*starts.tolist(), len(raw)]
    out, at = [], 0
    for lo, hi in gone:
        out.append(raw[at : bounds[lo]])
        at = bounds[hi]
    return b"".join([*out, raw[at:]])
