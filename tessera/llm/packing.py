"""Vector bin packing of examples into training sequences by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import encoder


@dataclass(slots=True)
class Piece:
    """Part of an example: ids[start:start + length], as bytes, and how many of them bear loss."""

    doc: int | None
    start: int
    ids: bytes
    loss: int
    total: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the rest; only pieces whose ids all bear loss, or none, can be cut."""
        bears = self.loss // self.length if self.length else 0
        return Piece(self.doc, self.start, self.ids[: 4 * n], bears * n, self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], bears * (self.length - n), self.total)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


def fill(pieces: list[Piece], limits: Limits, may_cut: bool) -> list[list[Piece]]:
    """Bins for the pieces; each piece fits an empty bin.

    A bin takes, of the pieces that fit, the one with the greatest dot product of its demand and the bin's room (both as
    parts of the limits, weighted by total demand), ties to the first; when none fits and `may_cut`, the front of the
    largest one fills the room.
    """
    most = np.array([limits.tokens, limits.segments, limits.loss], float)
    demand = np.array([[p.length, 1, p.loss] for p in pieces], float).reshape(-1, 3) / most
    weight = demand.sum(axis=0) / max(demand.sum(), 1e-12)
    weighted = demand * weight
    left = np.ones(len(pieces), bool)
    order = np.arange(len(pieces))
    bins: list[list[Piece]] = []
    while len(order):
        room, held = np.ones(3), []
        d, w = demand[order], weighted[order]
        alive = np.ones(len(order), bool)
        while True:
            fits = alive & (d <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, w @ room, -1.0)))
            alive[i] = False
            left[order[i]] = False
            held.append(pieces[order[i]])
            room = room - d[i]
        free = limits.tokens - sum(p.length for p in held)
        if may_cut and alive.any() and free > 0 and len(held) < limits.segments and sum(p.loss for p in held) + free <= limits.loss:
            k = int(order[int(np.argmax(np.where(alive, d[:, 0], -1.0)))])
            if pieces[k].length > free:
                front, pieces[k] = pieces[k].cut(free)
                held.append(front)
                demand[k] = np.array([pieces[k].length, 1, pieces[k].loss]) / most
                weighted[k] = demand[k] * weight
        bins.append(held)
        order = order[left[order]]
    return bins


def powers_of_two(held: list[Piece], limit: int) -> list[list[Piece]]:
    """The pieces of a bin that is not full, cut into sequences whose lengths are powers of two, longest first."""
    out, todo = [], list(held)
    rest = sum(p.length for p in held)
    while rest:
        want = min(limit, 1 << (rest.bit_length() - 1))
        rest -= want
        part: list[Piece] = []
        while want:
            p = todo.pop(0)
            if p.length > want:
                p, back = p.cut(want)
                todo.insert(0, back)
            part.append(p)
            want -= p.length
        out.append(part)
    return out


class Packer:
    """Packs a stream of examples in blocks of bounded size; a block's last bin goes on into the next block."""

    def __init__(self, limits: Limits, may_cut: bool, block: int):
        self.limits, self.may_cut, self.block = limits, may_cut, block
        self.waiting: list[Piece] = []

    def add(self, doc: int | None, ids: bytes, loss: int | None = None) -> Iterator[list[Piece]]:
        total, limit = len(ids) // 4, self.limits.tokens
        whole = Piece(doc, 0, ids, total if loss is None else loss, total)
        if not self.may_cut and (total > limit or whole.loss > self.limits.loss):
            raise ValueError(f"example {doc}: {total} tokens, {whole.loss} with loss; the limits are {limit} and {self.limits.loss}")
        while whole.length >= limit and self.may_cut:
            full, whole = whole.cut(limit) if whole.length > limit else (whole, None)
            yield [full]
            if whole is None:
                return
        if whole.length or not self.may_cut:
            self.waiting.append(whole)
        if len(self.waiting) >= self.block:
            bins = fill(self.waiting, self.limits, self.may_cut)
            self.waiting = bins.pop()
            yield from bins

    def finish(self) -> Iterator[list[Piece]]:
        for held in fill(self.waiting, self.limits, self.may_cut) if self.waiting else ():
            if self.may_cut and sum(p.length for p in held) < self.limits.tokens:
                yield from powers_of_two(held, self.limits.tokens)
            else:
                yield held
        self.waiting = []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack(rows: DataFrame, examples: Callable[[pa.RecordBatch], Iterable[tuple[int | None, bytes, int | None]]], limits: Limits, may_cut: bool = False, block: int = 2048) -> DataFrame:
    """One row per piece. Each partition packs its own rows in blocks, without a shuffle.

    examples turns a batch of `rows` into (doc_id, ids as little-endian unsigned 32-bit numbers, tokens with loss or
    None for all). sequence_id is unique: the partition's number and a count in it. With may_cut, examples longer than
    a sequence are cut and only the last bin of a partition is not full; it is cut into sequences whose lengths are
    powers of two, which need no padding. Without it, a longer example raises ValueError.
    Repeated rows are packed each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, count = Packer(limits, may_cut, block), 0
        first = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def written(held: list[Piece]) -> None:
            nonlocal count
            offset = 0
            for p in held:
                out.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.total, first + count, offset, p.loss))
                offset += p.length
            count += 1

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 8
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for doc, ids, loss in examples(batch):
                for held in packer.add(doc, ids, loss):
                    written(held)
            if len(out) > 5000:
                yield batch_of()
        for held in packer.finish():
            written(held)
        yield batch_of()

    return rows.mapInArrow(tidy(run), SCHEMA)


#: A piece has a token at least, so here tokens bind first and no bin closes unfull for its segments.
WHOLE_TEXTS = Limits(segments=2048)


def pack_documents(docs: DataFrame, path: str, limits: Limits = WHOLE_TEXTS, end_id: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs whole texts: the tokenizer's ids and then end_id, all bearing loss, cut freely. Null texts count as empty: end_id alone."""
    end = end_id.to_bytes(4, "little")

    def examples(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, None]]:
        e = encoder(path)
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            yield doc, e.encode(x.as_buffer().to_pybytes() if x.is_valid else b"") + end, None

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return pack(rows, examples, limits, may_cut=True)


def pack_conversations(turns: DataFrame, path: str, limits: Limits, end_id: int = 1, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bears_loss: str = "assistant") -> DataFrame:
    """Packs conversations whole, under limits on tokens, segments (examples in a sequence) and tokens with loss: those of the turns of one role, with their end_id.

    A row per example as pack() gives it, doc_id being the conversation; columns start and doc_tokens count in the example. A conversation beyond a limit goes on in a further
    example, cut between tokens. Turns follow `turn`, then role and text; a null text is empty, a null role bears no loss, and null
    conversations are one. Turns are streamed in order, so a conversation of any length holds no more than one example in memory.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        now, ids, loss, begun = None, bytearray(), 0, False

        def example(out: list[tuple]) -> None:
            nonlocal loss
            out.append((now, bytes(ids), loss))
            ids.clear()
            loss = 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], ["doc_id", "ids", "loss"])

        for batch in batches:
            out: list[tuple] = []
            for name, who, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                if begun and name != now and ids:
                    example(out)
                now, begun = name, True
                more = e.encode(said.as_buffer().to_pybytes() if said.is_valid else b"") + end
                at, bears = 0, who == bears_loss
                while at < len(more):
                    room = limits.tokens - len(ids) // 4
                    if bears:
                        room = min(room, limits.loss - loss)
                    if room <= 0:
                        example(out)
                        continue
                    part = more[at : at + 4 * room]
                    ids.extend(part)
                    loss += len(part) // 4 * bears
                    at += len(part)
            yield batch_of(out)
        if ids:
            out = []
            example(out)
            yield batch_of(out)

    rows = turns.select(F.col(conv).cast("long").alias("c"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"), F.col(turn).alias("n"))
    ordered = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    examples = ordered.mapInArrow(tidy(run), "doc_id long, ids binary, loss long")
    given = lambda batch: zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
    return pack(examples, given, limits)
