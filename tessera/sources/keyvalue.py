"""LMDB stores (data version 1, pages of 4096 bytes, little-endian) read and written without their library.

A sample's key is its number, eight digits or more; its value is a 32-bit label and the payload. Keys that begin with two
underscores hold facts about the whole store. Stores lie on a path that all executors mount.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
PAGE, HEADER, NODE = 4096, 16, 8
MAGIC, VERSION = 0xBEEFC0DE, 1
BRANCH, LEAF, OVERFLOW, META = 1, 2, 4, 8
BIG, SUBTREE, REPEATED = 1, 2, 4
INTEGER_KEYS = 8
NO_PAGE = (1 << 64) - 1
MOST_KEY = 511
#: A node beyond this size has its value on pages of its own.
MOST_NODE = ((PAGE - HEADER) // 2 & -2) - 2
PAGE_HEADER, NODE_HEADER = "<QHHHH", "<HHHH"
META_HEAD, TREE, META_TAIL = "<IIQQ", "<IHHQQQQQ", "<QQ"

KEY_VALUES = "key string, label long, payload binary"
#: Bytes of payload in a batch that a reading task hands on.
BATCH = 8 << 20


class Writer:
    """One store from (key, value) in ascending order of keys, page by page; only the first key of each page is kept."""

    def __init__(self, file):
        self.file, self.next = file, 2
        self.counts = {BRANCH: 0, LEAF: 0, OVERFLOW: 0}
        self.entries, self.last = 0, None
        file.write(bytes(2 * PAGE))

    def page(self, kind: int, nodes: list[bytes]) -> int:
        """Writes a page whose nodes lie from its end downwards, and gives its number."""
        places, at = [], PAGE
        for node in nodes:
            at -= len(node)
            places.append(at)
        head = struct.pack(PAGE_HEADER, self.next, 0, kind, HEADER + 2 * len(nodes), at) + struct.pack(f"<{len(places)}H", *places)
        self.file.write(head + bytes(at - len(head)) + b"".join(reversed(nodes)))
        self.counts[kind] += 1
        self.next += 1
        return self.next - 1

    def overflow(self, value: bytes) -> int:
        pages, first = -(-(HEADER + len(value)) // PAGE), self.next
        self.file.write(struct.pack("<QHHI", first, 0, OVERFLOW, pages) + value + bytes(pages * PAGE - HEADER - len(value)))
        self.counts[OVERFLOW] += pages
        self.next += pages
        return first

    def leaf_node(self, key: bytes, value: bytes) -> bytes:
        if not 0 < len(key) <= MOST_KEY:
            raise ValueError(f"a key has {len(key)} bytes; LMDB takes 1 to {MOST_KEY}")
        if self.last is not None and key <= self.last:
            raise ValueError("keys must ascend")
        self.last, flags, size = key, 0, len(value)
        if NODE + len(key) + size > MOST_NODE:
            value, flags = struct.pack("<Q", self.overflow(value)), BIG
        node = struct.pack(NODE_HEADER, size & 0xFFFF, size >> 16, flags, len(key)) + key + value
        return node + bytes(len(node) % 2)

    def write(self, items: Iterable[tuple[bytes, bytes]]) -> None:
        level, nodes, used, first = [], [], HEADER, b""
        for key, value in items:
            node = self.leaf_node(key, value)
            if used + len(node) + 2 > PAGE:
                level.append((first, self.page(LEAF, nodes)))
                nodes, used = [], HEADER
            if not nodes:
                first = key
            nodes.append(node)
            used += len(node) + 2
            self.entries += 1
        if nodes:
            level.append((first, self.page(LEAF, nodes)))
        depth = 1 if level else 0
        while len(level) > 1:
            level, depth = [(group[0][0], self.page(BRANCH, [self.branch_node(b"" if i == 0 else k, p) for i, (k, p) in enumerate(group)])) for group in grouped(level)], depth + 1
        root = level[0][1] if level else NO_PAGE
        free = struct.pack(TREE, PAGE, INTEGER_KEYS, 0, 0, 0, 0, 0, NO_PAGE)
        trees = struct.pack(TREE, 0, 0, 0, 0, 0, 0, 0, NO_PAGE), struct.pack(TREE, 0, 0, depth, self.counts[BRANCH], self.counts[LEAF], self.counts[OVERFLOW], self.entries, root)
        self.file.seek(0)
        for n, (tree, last) in enumerate(zip(trees, (1, self.next - 1), strict=True)):
            body = struct.pack(PAGE_HEADER, n, 0, META, 0, 0) + struct.pack(META_HEAD, MAGIC, VERSION, 0, max(1 << 20, self.next * PAGE)) + free + tree + struct.pack(META_TAIL, last, n)
            self.file.write(body + bytes(PAGE - len(body)))

    @staticmethod
    def branch_node(key: bytes, page: int) -> bytes:
        node = struct.pack(NODE_HEADER, page & 0xFFFF, page >> 16 & 0xFFFF, page >> 32, len(key)) + key
        return node + bytes(len(node) % 2)


def grouped(level: list[tuple[bytes, int]]) -> list[list[tuple[bytes, int]]]:
    """Children of branch pages: as many as fit, two at least."""
    groups, used = [[]], HEADER
    for key, page in level:
        size = NODE + len(key) + len(key) % 2 + 2
        if used + size > PAGE:
            groups.append([])
            used = HEADER
        groups[-1].append((key, page))
        used += size
    if len(groups) > 1 and len(groups[-1]) == 1:
        groups[-1].insert(0, groups[-2].pop())
    return groups


class Store:
    """A store's pages, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        found = []
        for n in (0, 1):
            at = n * PAGE + HEADER
            magic, version, _, _ = struct.unpack_from(META_HEAD, self.data, at)
            size = struct.unpack_from(TREE, self.data, at + struct.calcsize(META_HEAD))[0]
            if (magic, version, size) != (MAGIC, VERSION, PAGE):
                raise ValueError(f"{path} is not an LMDB store with pages of {PAGE} bytes")
            tree = struct.unpack_from(TREE, self.data, at + struct.calcsize(META_HEAD) + struct.calcsize(TREE))
            found.append((struct.unpack_from(META_TAIL, self.data, at + struct.calcsize(META_HEAD) + 2 * struct.calcsize(TREE))[1], tree[6], tree[7]))
        _, self.entries, self.root = max(found)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.data.close()

    def nodes(self, page: int) -> tuple[int, list[int]]:
        """A page's kind and where its nodes begin."""
        at = page * PAGE
        _, _, kind, lower, _ = struct.unpack_from(PAGE_HEADER, self.data, at)
        n = (lower - HEADER) // 2
        return kind, [at + x for x in struct.unpack_from(f"<{n}H", self.data, at + HEADER)]

    def child(self, at: int) -> int:
        lo, hi, top, _ = struct.unpack_from(NODE_HEADER, self.data, at)
        return lo | hi << 16 | top << 32

    def units(self) -> list[int]:
        """Pages below the root, each the top of a part of the tree; a few hundred at most."""
        if self.root == NO_PAGE:
            return []
        kind, nodes = self.nodes(self.root)
        return [self.child(at) for at in nodes] if kind & BRANCH else [self.root]

    def items(self, page: int) -> Iterator[tuple[bytes, bytes]]:
        kind, nodes = self.nodes(page)
        for at in nodes:
            if kind & BRANCH:
                yield from self.items(self.child(at))
                continue
            lo, hi, flags, length = struct.unpack_from(NODE_HEADER, self.data, at)
            if flags & (SUBTREE | REPEATED):
                raise ValueError("named databases and repeated keys are not read")
            size, key = lo | hi << 16, self.data[at + NODE : at + NODE + length]
            begin = at + NODE + length
            if flags & BIG:
                begin = struct.unpack_from("<Q", self.data, begin)[0] * PAGE + HEADER
            yield key, self.data[begin : begin + size]

    def get(self, key: bytes) -> bytes | None:
        page = self.root
        while page != NO_PAGE:
            kind, nodes = self.nodes(page)
            if not kind & BRANCH:
                return next((v for k, v in self.items(page) if k == key), None)
            keys = [self.data[at + NODE : at + NODE + struct.unpack_from(NODE_HEADER, self.data, at)[3]] for at in nodes]
            page = self.child(nodes[max(i for i, k in enumerate(keys) if i == 0 or k <= key)])
        return None


def stores(path: str) -> list[str]:
    """The data files at or below a path, in order."""
    at = path.removeprefix("file:")
    if os.path.isfile(at):
        return [at]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(".mdb") and f != "lock.mdb")


def facts(path: str) -> list[dict[str, object]]:
    """What each store says of itself: path, entries, and len, num_classes, label_map where it has them."""
    out = []
    for name in stores(path):
        with Store(name) as store:
            said = {k: store.get(f"__{k}__".encode()) for k in ("len", "num_classes", "label_map")}
            out.append({"path": name, "entries": store.entries} | {k: json.loads(v) for k, v in said.items() if v is not None})
    return out


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, label, payload): the samples of the stores at or below a path, a task for each part of a tree. No store or no sample: no rows."""
    units = []
    for name in stores(path):
        with Store(name) as store:
            units += [(name, page) for page in store.units()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("label", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Store(name) as store:
                    rows, size = [], 0
                    for key, value in store.items(page):
                        if key.startswith(b"__"):
                            continue
                        rows.append((key.decode(), int.from_bytes(value[:4], "little", signed=True), value[4:]))
                        size += len(value) + 64
                        if size > BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = spark.createDataFrame(units, "store string, page long")
    return parts.repartition(max(1, min(len(units), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, KEY_VALUES)


def write_key_values(rows: DataFrame, path: str, count: int = 1, label_map: dict[str, int] | None = None) -> DataFrame:
    """Writes rows (idx, label, payload) as `count` stores by ranges of idx, and gives (store, entries).

    Rows with a null idx, label or payload are left out, and of rows with one idx all but the first by label and payload. A
    store's name follows its range, and it is put in place as a whole: a task that runs again replaces its own file. num_classes is
    that of all rows. An empty table gives no store.
    """
    folder = path.removeprefix("file:")
    good = rows.where(F.col("idx").isNotNull() & F.col("label").isNotNull() & F.col("payload").isNotNull())
    key = F.when(F.col("idx") < 100_000_000, F.lpad(F.col("idx").cast("string"), 8, "0")).otherwise(F.col("idx").cast("string"))
    classes = good.select("label").distinct().count()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        last = None
        for batch in batches:
            for name, label, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    yield name.encode(), struct.pack("<i", label) + payload
                last = name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pairs(batches)
        first = next(found, None)
        if first is None:
            return
        task = TaskContext.get()
        at = f"{folder}/part-{task.partitionId():05d}"
        os.makedirs(at, exist_ok=True)
        own = f"{at}/{task.taskAttemptId()}.part"
        n = 0

        def items() -> Iterator[tuple[bytes, bytes]]:
            nonlocal n
            for item in chain([first], found):
                n += 1
                yield item
            # Facts sort behind all digits, in this order.
            if label_map is not None:
                yield b"__label_map__", json.dumps(label_map, ensure_ascii=False).encode()
            yield b"__len__", str(n).encode()
            yield b"__num_classes__", str(classes).encode()

        with open(own, "wb") as f:
            Writer(f).write(items())
        os.replace(own, f"{at}/data.mdb")
        yield pa.RecordBatch.from_pydict({"store": [at], "entries": [n]})

    dealt = good.select(key.alias("key"), F.col("label").cast("int").alias("label"), F.col("payload").cast("binary").alias("payload"))
    return dealt.repartitionByRange(count, "key").sortWithinPartitions("key", "label", "payload").mapInArrow(run, "store string, entries long")

