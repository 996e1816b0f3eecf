"""Pieces that several text operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the white space between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240229)
#: A random 64-bit value per byte, and odd bases with their inverses modulo 2**64, for rolling hashes.
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is missing, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            own = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder and read from there.

    Lineage ends here: a lost executor costs no earlier stage. Unlike checkpoint(), this computes the rows once.
    """
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[made] = path
    for record in _records:
        record.append(path)
    return made


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_records: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds to paths the tables that cut() writes meanwhile."""
    _records.append(paths)
    try:
        yield
    finally:
        _records.remove(paths)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables from cut() that no later plan reads, and the shuffle files of finished jobs, which Spark frees when their plans are collected."""
    for t in tables:
        remove(t.sparkSession, _paths[t])
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def with_row_key(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(key, doc_id, text), null texts as empty ones; key is equal for equal rows only."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("h")).alias("key"), F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `most` bytes of text: (rows, bytes of all their texts, where each text starts and the last ends).

    Texts are never split; one longer than `most` makes a part of its own.
    """
    if not batch.num_rows:
        return
    whole = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None and whole.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_libc = None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system when its task ends, as workers outlive their tasks."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _libc
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                _libc = _libc or ctypes.CDLL("libc.so.6")
                _libc.malloc_trim(0)
            except (OSError, AttributeError):  # another C library: its own allocator decides
                pass

    return ended


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most `rows`, so that Python objects are held for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within texts: (starts, ends, the text of each)."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][full]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][full] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
        _powers[base] = have
    return have[:n]


class Spans:
    """Hashes of values[start:end] for many spans, by prefix sums that are made once."""

    def __init__(self, values: np.ndarray, base: int):
        self.prefix = np.empty(len(values) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(values * powers(base, len(values)), out=self.prefix[1:])
        self.scale = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.scale[starts]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span."""
    return Spans(values, base)(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(span_hashes(BYTE_VALUE[data], starts, ends, BASE) + (ends - starts).astype(np.uint64))
