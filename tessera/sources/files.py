"""Collections of samples in folders, archives, tables and made-up data, as DataFrames; and the choice among them."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "idx long, path string, label long"


def sample_index(spark: SparkSession, path: str) -> DataFrame:
    """A headerless table of tabs: idx, path, label."""
    return spark.read.csv(path, sep="\t", schema=INDEX)


def write_sample_index(rows: DataFrame, path: str) -> None:
    rows.select("idx", "path", "label").write.mode("overwrite").csv(path, sep="\t")


def folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, class, label, content): files of the folders below root; a folder is a class, labels number them in their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class"), "content")
    labels = named.select("class").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("class")) - 1).cast("long"))
    return named.join(labels, "class").select("path", "class", "label", "content")


def folder_cached(spark: SparkSession, root: str, cache: str, **how) -> DataFrame:
    """folder() without content, kept as Parquet: written once, read from then on."""
    try:
        return spark.read.parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    folder(spark, root, **how).select("path", F.col("label").cast("int")).write.option("compression", "zstd").parquet(cache)
    return spark.read.parquet(cache)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, key, kind, content): members of tar files; a sample is the members that share a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    out = [(archive, m.name, m.name.split(".")[0], m.name.partition(".")[2], tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pd.DataFrame(out, columns=["archive", "name", "key", "kind", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, name string, key string, kind string, content binary")


def write_archives(rows: DataFrame, path: str, shards: int) -> DataFrame:
    """Writes rows (key, kind, content) as tar files of whole samples, one for each shard, and gives (archive, members). Samples lie in a shard by their key."""
    folder_path = path.removeprefix("file:")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder_path, exist_ok=True)
        name, n = f"{folder_path}/{uuid.uuid4().hex}", 0
        with tarfile.open(name + ".part", "w") as tar:
            for batch in batches:
                for key, kind, content in batch[["key", "kind", "content"]].itertuples(index=False):
                    info = tarfile.TarInfo(f"{key}.{kind}")
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                    n += 1
        os.replace(name + ".part", name + ".tar")
        yield pd.DataFrame({"archive": [name + ".tar"], "members": [n]})

    dealt = rows.select("key", "kind", "content").repartition(shards, "key").sortWithinPartitions("key", "kind")
    return dealt.mapInPandas(run, "archive string, members long")


def arrow_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow stream or file datasets in a folder, of the given schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                try:
                    table = pa.ipc.open_stream(content).read_all()
                except pa.ArrowInvalid:
                    table = pa.ipc.open_file(content).read_all()
                yield from table.to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path)
    return files.select("content").mapInArrow(run, schema)


OPTIONAL = {"hdf5": "h5py", "zarr": "zarr", "mds": "streaming"}


def optional(kind: str):
    """The library of a format that is read only where it is installed."""
    try:
        return __import__(OPTIONAL[kind])
    except ImportError as e:
        raise NotImplementedError(f"{kind} needs the library `{OPTIONAL[kind]}`, which is not installed") from e


def synthetic(spark: SparkSession, samples: int, classes: int, seed: int = 0) -> DataFrame:
    """(idx, label, payload): a constant payload and labels that follow from the seed."""
    label = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(classes))
    return spark.range(samples).select(F.col("id").alias("idx"), label.alias("label"), F.lit(b"\x00" * 16).alias("payload"))


def replicas(spark: SparkSession, keys: int, each: int, dim: int, noise: float, seed: int = 0) -> DataFrame:
    """(key, image, v): for each key a base vector and `each` noisy copies; a row follows from seed, key and number alone."""
    uniform = lambda *of: (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))

    def normal(tag: str, *of):
        return F.sqrt(-2 * F.log(uniform(F.lit(tag + "u"), *of))) * F.cos(2 * 3.141592653589793 * uniform(F.lit(tag + "v"), *of))

    rows = spark.range(keys).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("image"))
    base = lambda d: normal("base", F.lit(seed), F.col("key"), d)
    own = lambda d: normal("own", F.lit(seed), F.col("key"), F.col("image"), d)
    return rows.withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: base(d) + noise * own(d)))


def kind_of(names: list[str], is_synthetic: bool = False) -> str:
    """What a folder with these entries holds: made-up data, a key-value store, records, arrow files, archives, else folders of files."""
    if is_synthetic:
        return "synthetic"
    if any(n in ("data.mdb", "lmdb") for n in names):
        return "lmdb"
    if any(n.endswith(".rec") for n in names):
        return "recordio"
    if any(n.endswith(".arrow") or n == "dataset_info.json" for n in names):
        return "arrow"
    if any(n.endswith(".tar") for n in names):
        return "tar"
    if not names:
        raise FileNotFoundError("the folder is empty")
    return "folder"


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by the file system that Spark would use."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def read_any(spark: SparkSession, path: str, **how) -> DataFrame:
    """The samples of a folder, whatever it holds."""
    kind = kind_of(entries(spark, path))
    if kind == "recordio":
        register(spark)
        return spark.read.format("recordio").load(path)
    if kind == "lmdb":
        from .keyvalue import key_values

        return key_values(spark, path)
    if kind == "tar":
        return archives(spark, path)
    if kind == "arrow":
        return arrow_files(spark, path, **how)
    return folder(spark, path, **how)


def register(spark: SparkSession) -> None:
    from .recordio import RecordIO

    spark.dataSource.register(RecordIO)


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, name, length): files below root, natural order by name is for the caller to ask with natural_keys()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def natural_keys(name: str) -> list[object]:
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON file that is there as a whole or not at all: written beside its place, then renamed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise OSError(f"{path} could not be written")


def metrics_sink(path: str):
    """A function for foreachBatch that appends metric rows; a batch that comes again after a failure replaces its own rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
