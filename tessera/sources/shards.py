"""Sharded samples and chunked arrays in open layouts, read and written without their libraries.

Shards: `index.json` names the shards and their columns; a shard is a count, offsets of the samples, and for each sample the
sizes of its columns of varying size and then their bytes. Arrays: `.zarray` describes an uncompressed array of rows, each chunk a file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_json


def shard_bytes(samples: list[tuple[int, bytes]]) -> bytes:
    """A shard of (label, payload)."""
    bodies = [struct.pack("<I", len(p)) + struct.pack("<q", label) + p for label, p in samples]
    at = 4 + 4 * (len(bodies) + 1)
    offsets = [at]
    for b in bodies:
        offsets.append(offsets[-1] + len(b))
    return struct.pack("<I", len(bodies)) + struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(bodies)


def shard_samples(data: bytes) -> Iterator[tuple[int, bytes]]:
    (n,) = struct.unpack_from("<I", data)
    offsets = struct.unpack_from(f"<{n + 1}I", data, 4)
    for a, b in zip(offsets, offsets[1:], strict=False):
        (size,) = struct.unpack_from("<I", data, a)
        (label,) = struct.unpack_from("<q", data, a + 4)
        if a + 12 + size != b:
            raise ValueError(f"a sample at {a} has {b - a} bytes")
        yield label, data[a + 12 : b]


def write_shards(rows: DataFrame, path: str, shards: int) -> int:
    """Writes rows (idx, label, payload) as shards of ranges of idx, with an index; gives the number of samples."""
    folder = path.removeprefix("file:")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        pdf = pd.concat(list(batches) or [pd.DataFrame(columns=["idx", "label", "payload"])])
        if len(pdf):
            name = f"shard.{int(pdf['idx'].iloc[0]):012d}.mds"
            data = shard_bytes(list(zip(pdf["label"].astype(int).tolist(), pdf["payload"].tolist(), strict=True)))
            with open(f"{folder}/{name}.part", "wb") as f:
                f.write(data)
            os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
            yield pd.DataFrame({"name": [name], "samples": [len(pdf)], "bytes": [len(data)]})

    made = rows.select("idx", "label", "payload").repartitionByRange(shards, "idx").sortWithinPartitions("idx").mapInPandas(run, "name string, samples long, bytes long").collect()
    entry = lambda r: {"column_encodings": ["int", "bytes"], "column_names": ["label", "payload"], "column_sizes": [8, None], "compression": None, "format": "mds", "samples": r["samples"], "raw_data": {"basename": r["name"], "bytes": r["bytes"]}}
    write_json(rows.sparkSession, f"{path}/index.json", {"version": 2, "shards": [entry(r) for r in sorted(made, key=lambda r: r["name"])]})
    return sum(r["samples"] for r in made)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, place, label, payload) of the shards that the index names; another count than the index states is an error."""
    index = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0])
    stated = {s["raw_data"]["basename"]: s["samples"] for s in index["shards"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                if name in stated:
                    samples = list(shard_samples(content))
                    if len(samples) != stated[name]:
                        raise ValueError(f"{name} has {len(samples)} samples, the index states {stated[name]}")
                    yield pd.DataFrame({"shard": name, "place": range(len(samples)), "label": [s[0] for s in samples], "payload": [s[1] for s in samples]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mds").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInPandas(run, "shard string, place long, label long, payload binary")


def write_array(rows: DataFrame, path: str, dim: int, chunk: int = 256) -> int:
    """Writes rows (idx from 0 on without gaps, v) as an array of 64-bit floats, `chunk` rows in a file; gives the number of rows."""
    folder, n = path.removeprefix("file:"), rows.count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        os.makedirs(folder, exist_ok=True)
        number = int(pdf["chunk"].iloc[0])
        block = np.zeros((chunk, dim), "<f8")
        block[pdf["idx"].to_numpy() - number * chunk] = np.stack(pdf["v"].to_numpy())
        with open(f"{folder}/{number}.0.part", "wb") as f:
            f.write(block.tobytes())
        os.replace(f"{folder}/{number}.0.part", f"{folder}/{number}.0")
        return pd.DataFrame({"chunk": [number]})

    rows.select("idx", "v", F.floor(F.col("idx") / chunk).alias("chunk")).groupBy("chunk").applyInPandas(run, "chunk long").count()
    write_json(rows.sparkSession, f"{path}/.zarray", {"zarr_format": 2, "shape": [n, dim], "chunks": [chunk, dim], "dtype": "<f8", "compressor": None, "filters": None, "fill_value": 0, "order": "C"})
    return n


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(idx, v): rows of an array of two dimensions whose chunks hold whole rows and are not compressed."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/.zarray")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    meta = json.loads(bytes(stream.readAllBytes()).decode())
    stream.close()
    if meta["compressor"] is not None or meta["chunks"][1] != meta["shape"][1]:
        raise NotImplementedError("only uncompressed chunks of whole rows are read")
    n, dim, chunk, kind = meta["shape"][0], meta["shape"][1], meta["chunks"][0], meta["dtype"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                first = int(name.split(".")[0]) * chunk
                block = np.frombuffer(content, kind).reshape(-1, dim)[: max(0, n - first)].astype(float)
                yield pd.DataFrame({"idx": np.arange(first, first + len(block)), "v": list(block)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.[0-9]*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInPandas(run, "idx long, v array<double>")
