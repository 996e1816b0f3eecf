"""RecordIO files as a Spark data source: `spark.read.format("recordio")` and `df.write.format("recordio")`.

A record is a magic word, a word with its length in the low 29 bits and its part kind in the others, the payload, and zeros up to the
next multiple of four. A payload with the magic word inside is stored in parts (kinds 1, 2 ... 2, 3) that are joined by that word.
Images carry a header of 24 bytes: flag, label, id and id2; if flag is over 0, that many float labels follow it.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MAGIC = 0xCED7230A
HEADER = struct.Struct("<IfQQ")
WORDS = struct.Struct("<II")
LENGTH_BITS = 29

SCHEMA = "idx long, flag int, label double, labels array<float>, id long, id2 long, payload binary"


class CorruptRecord(ValueError):
    """A record without the magic word, or one that ends too early."""


def read_record(data: memoryview, at: int) -> tuple[bytes, int]:
    """(payload, where the next record begins) of the record at `at`."""
    parts: list[bytes] = []
    while True:
        if at + WORDS.size > len(data):
            raise CorruptRecord(f"a record ends at {at}")
        magic, word = WORDS.unpack_from(data, at)
        if magic != MAGIC:
            raise CorruptRecord(f"no record at {at}")
        kind, n = word >> LENGTH_BITS, word & ((1 << LENGTH_BITS) - 1)
        begin = at + WORDS.size
        if begin + n > len(data):
            raise CorruptRecord(f"a record ends at {at}")
        parts.append(bytes(data[begin : begin + n]))
        at = begin + -(-n // 4) * 4
        if kind in (0, 3):
            return struct.pack("<I", MAGIC).join(parts), at
        if kind not in (1, 2):
            raise CorruptRecord(f"part kind {kind}")


def write_record(payload: bytes) -> bytes:
    """A payload as a record; aligned magic words inside it divide it into parts."""
    word = struct.pack("<I", MAGIC)
    parts, begin = [], 0
    for at in range(0, len(payload) - 3, 4):
        if payload[at : at + 4] == word:
            parts.append(payload[begin:at])
            begin = at + 4
    parts.append(payload[begin:])
    out = []
    for i, part in enumerate(parts):
        kind = 0 if len(parts) == 1 else 1 if i == 0 else 3 if i == len(parts) - 1 else 2
        out.append(WORDS.pack(MAGIC, kind << LENGTH_BITS | len(part)) + part + bytes(-len(part) % 4))
    return b"".join(out)


def unpacked(record: bytes) -> tuple[int, float, list[float], int, int, bytes]:
    flag, label, first, second = HEADER.unpack_from(record)
    rest = record[HEADER.size :]
    labels = list(struct.unpack_from(f"<{flag}f", rest)) if flag else []
    return flag, label, labels, first, second, rest[4 * flag :]


def packed(label: float, labels: list[float] | None, first: int, second: int, payload: bytes) -> bytes:
    labels = labels or []
    return HEADER.pack(len(labels), 0.0 if labels else label, first, second) + struct.pack(f"<{len(labels)}f", *labels) + payload


def index_lines(path: str) -> list[tuple[int, int]]:
    """(idx, offset) of the lines of an index file."""
    with open(path) as f:
        return [(int(a), int(b)) for a, b in (line.split("\t") for line in f if line.strip())]


@dataclass
class Range(InputPartition):
    path: str
    entries: list[tuple[int, int]]

    def __init__(self, path: str, entries: list[tuple[int, int]]):
        self.path, self.entries = path, entries


class RecordReader(DataSourceReader):
    """Reads ranges of records by the offsets of the index files; a file without an index is read in order."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"].removeprefix("file:"), int(options.get("recordsPerPartition", 4096))

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".rec"))
        return [self.path]

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files():
            index = path.removesuffix(".rec") + ".idx"
            if not os.path.exists(index):
                out.append(Range(path, []))
                continue
            entries = sorted(index_lines(index), key=lambda e: e[1])
            out += [Range(path, entries[i : i + self.step]) for i in range(0, len(entries), self.step)]
        if not out:
            raise FileNotFoundError(f"no .rec file in {self.path}")
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        size = os.path.getsize(partition.path)
        with open(partition.path, "rb") as f:
            if not partition.entries:
                data, at, idx = memoryview(f.read()), 0, 0
                while at < size:
                    record, at = read_record(data, at)
                    yield (idx, *unpacked(record))
                    idx += 1
                return
            bounds = [o for _, o in partition.entries]
            f.seek(bounds[0])
            # One read takes the range: the next range's first record ends it at the latest.
            rest = f.read(bounds[-1] - bounds[0])
            tail = f.read(WORDS.size)
            while True:
                try:
                    read_record(memoryview(rest + tail), bounds[-1] - bounds[0])
                    break
                except CorruptRecord:
                    more = f.read(1 << 16)
                    if not more:
                        raise
                    tail += more
            data = memoryview(rest + tail)
            for idx, offset in partition.entries:
                yield (idx, *unpacked(read_record(data, offset - bounds[0])[0]))


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class RecordWriter(DataSourceWriter):
    """Each task writes a file and its index under names of its own; commit gives them their last names, abort removes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file:"), overwrite
        self.temporary = f"{self.path}/_{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.temporary, exist_ok=True)
        name, n, at = f"{self.temporary}/{uuid.uuid4().hex}", 0, 0
        with open(name + ".rec", "wb") as rec, open(name + ".idx", "w") as idx:
            for r in rows:
                record = write_record(packed(r.label or 0.0, r.labels, r.id or 0, r.id2 or 0, bytes(r.payload or b"")))
                idx.write(f"{r.idx}\t{at}\n")
                rec.write(record)
                at, n = at + len(record), n + 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [f for f in os.listdir(self.path) if f.endswith((".rec", ".idx"))] if self.overwrite else []
        for f in old:
            os.remove(f"{self.path}/{f}")
        have = sum(f.endswith(".rec") for f in os.listdir(self.path))
        for i, m in enumerate(m for m in messages if m is not None):
            for kind in (".rec", ".idx"):
                os.replace(m.path + kind, f"{self.path}/part-{have + i:05d}{kind}")
        if os.path.isdir(self.temporary):
            os.rmdir(self.temporary)

    def abort(self, messages: list) -> None:
        for m in messages:
            for kind in (".rec", ".idx") if m is not None else ():
                if os.path.exists(m.path + kind):
                    os.remove(m.path + kind)


class RecordIO(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordio"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)
