"""Queries that write the driver's tables in a format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import files, keyvalue, shards
from . import base
from .base import E, r6
from .registry import query, table


def place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def payloads(spark, sf_dir):
    """(idx, label, payload): each row's vector as text bytes."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.col("label").cast("double").alias("label"), F.concat(F.lit("img-"), F.col("vec_id").cast("string"), F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int"))).cast("binary").alias("payload"))


SAMPLES = "SELECT vec_id AS idx, CAST(label AS DOUBLE) AS label, CAST(4 + length(CAST(vec_id AS VARCHAR)) + vec_id % 7 AS BIGINT) AS n_bytes FROM embeddings"


def records(spark, sf_dir):
    files.register(spark)
    rows = payloads(spark, sf_dir).select("idx", F.lit(0).alias("flag"), "label", F.lit(None).cast("array<float>").alias("labels"), F.col("idx").alias("id"), F.lit(0).cast("long").alias("id2"), "payload")
    at = place(spark, "records")
    rows.repartitionByRange(4, "idx").sortWithinPartitions("idx").write.format("recordio").mode("append").save(at)
    return at


def sizes(rows):
    return rows.select("idx", "label", F.octet_length("payload").cast("long").alias("n_bytes"))


@query(SAMPLES)
def scan_recordio(spark, sf_dir):
    return sizes(spark.read.format("recordio").option("recordsPerPartition", "100").load(records(spark, sf_dir)))


@query(SAMPLES)
def sink_recordio(spark, sf_dir):
    return sizes(spark.read.format("recordio").load(records(spark, sf_dir)))


@query(SAMPLES)
def scan_recordio_bench(spark, sf_dir):
    """Records without the header record that holds the count."""
    return sizes(spark.read.format("recordio").load(records(spark, sf_dir)).where("idx >= 0"))


@query(SAMPLES)
def scan_dispatch(spark, sf_dir):
    return sizes(files.read_any(spark, records(spark, sf_dir)))


@query("SELECT vec_id AS idx, 'img/' || vec_id || '.jpg' AS path, CAST(label AS BIGINT) AS label FROM embeddings")
def scan_record_index(spark, sf_dir):
    at = place(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("img/"), F.col("vec_id"), F.lit(".jpg")).alias("path"), F.col("label").cast("long").alias("label"))
    files.write_sample_index(rows, at)
    return files.sample_index(spark, at)


@query("SELECT vec_id AS idx, CAST(vec_id * 64 AS BIGINT) AS place FROM embeddings")
def scan_offsets_cached(spark, sf_dir):
    """Offsets as a table of their own, read again from Parquet."""
    at = place(spark, "offsets")
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") * 64).alias("place")).write.parquet(at)
    return spark.read.parquet(at)


@query("SELECT 'k' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS key, CAST(label AS BIGINT) AS label FROM embeddings")
def scan_webdataset(spark, sf_dir):
    """Samples in tar shards: two members each, joined by their key."""
    at = place(spark, "tar")
    rows = payloads(spark, sf_dir).withColumn("key", F.concat(F.lit("k"), F.lpad(F.col("idx").cast("string"), 8, "0")))
    members = rows.select("key", F.lit("img").alias("kind"), F.col("payload").alias("content")).union(rows.select("key", F.lit("cls"), F.col("label").cast("long").cast("string").cast("binary")))
    files.write_archives(members, at, 4).count()
    read = files.archives(spark, at)
    return read.groupBy("key").agg(F.max(F.when(F.col("kind") == "cls", F.col("content").cast("string").cast("long"))).alias("label"))


@query("SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings")
def scan_hf_arrow(spark, sf_dir):
    import pyarrow as pa

    at = place(spark, "arrow")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))

    def run(batches):
        import os

        folder = at.removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            name = f"{folder}/{uuid.uuid4().hex}"
            with pa.OSFile(name + ".part", "wb") as f, pa.ipc.new_stream(f, batch.schema) as out:
                out.write_batch(batch)
            os.replace(name + ".part", name + ".arrow")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").count()
    return files.arrow_files(spark, at, "vec_id long, label long")


@query("SELECT c_custkey, c_name FROM customer")
def scan_csv(spark, sf_dir):
    at = place(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.csv(at, header=True)
    return spark.read.csv(at, header=True, schema="c_custkey long, c_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def sink_csv(spark, sf_dir):
    at = place(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(at, header=True)
    return spark.read.csv(at, header=True, schema="n_nationkey int, n_name string")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) + 0.0 AS price FROM orders")
def sink_parquet(spark, sf_dir):
    at = place(spark, "pairs")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.round("o_totalprice", 2) + 0.0).alias("price")).write.parquet(at)
    return spark.read.parquet(at)


@query("SELECT event_type AS metric, count(*) AS n FROM events GROUP BY 1")
def sink_json_atomic(spark, sf_dir):
    """A small result as one JSON file, which is there as a whole or not at all."""
    at = place(spark, "result") + ".json"
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    files.write_json(spark, at, [{"metric": r["event_type"], "n": r["n"]} for r in counts.collect()])
    return spark.read.schema("metric string, n long").json(at, multiLine=True)


@query(f"WITH {E} SELECT vec_id, label, {r6('v[1]')} AS first, CAST(len(v) AS BIGINT) AS dim FROM e")
def sink_feature_cache(spark, sf_dir):
    at = place(spark, "features")
    base.vectors(spark, sf_dir).select("vec_id", "label", "v").write.mode("overwrite").parquet(at)
    read = spark.read.parquet(at)
    return read.select("vec_id", "label", (F.round(F.col("v")[0], 6) + 0.0).alias("first"), F.size("v").cast("long").alias("dim"))


@query("SELECT user_id AS run, event_type AS metric, count(*) AS n FROM events GROUP BY 1, 2")
def sink_tracker(spark, sf_dir):
    """Metric rows appended by batches; a batch that is written twice counts once."""
    at = place(spark, "metrics")
    sink = files.metrics_sink(at)
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    for batch in (0, 1, 1):
        sink(rows.where(F.col("run") % 2 == batch), batch)
    return spark.read.parquet(at).select("run", "metric", "n")


@query("SELECT vec_id AS idx, CAST(label AS BIGINT) AS label FROM embeddings")
def scan_folder(spark, sf_dir):
    """Files in folders by class; the folder's order gives the label."""
    at = class_folders(spark, sf_dir)
    read = files.folder(spark, at)
    return read.select(F.regexp_extract("path", r"([0-9]+)\.jpg$", 1).cast("long").alias("idx"), F.regexp_extract("class", "([0-9]+)$", 1).cast("long").alias("label"))


@query()
def scan_synthetic(spark, sf_dir):
    return files.synthetic(spark, 1000, 100, seed=1).select("idx", "label")


@query()
def gen_synth(spark, sf_dir):
    made = files.replicas(spark, 50, 4, 16, 0.1, seed=3)
    return made.select("key", "image", (F.round(F.col("v")[0], 9) + 0.0).alias("first"))


LABELS = "SELECT vec_id AS idx, CAST(label AS BIGINT) AS label FROM embeddings"


def shard_rows(spark, sf_dir):
    at = place(spark, "shards")
    shards.write_shards(payloads(spark, sf_dir), at, 4)
    number = F.regexp_extract(F.col("payload").cast("string"), "([0-9]+)", 1).cast("long")
    return shards.read_shards(spark, at).select(number.alias("idx"), "label")


@query(LABELS)
def scan_mds(spark, sf_dir):
    """Samples of indexed shards."""
    return shard_rows(spark, sf_dir)


def stored(spark, sf_dir, count, times=1):
    """Where samples lie as key-value stores, and (store, entries) of each; payloads are repeated `times`."""
    at = place(spark, "stores")
    rows = payloads(spark, sf_dir).withColumn("payload", F.repeat(F.col("payload").cast("string"), times).cast("binary"))
    return at, keyvalue.write_key_values(rows, at, count)


@query("SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS key, CAST(label AS BIGINT) AS label, 'img-' || vec_id || repeat('x', CAST(vec_id % 7 AS INTEGER)) AS payload FROM embeddings WHERE vec_id < 100000000")
def scan_lmdb(spark, sf_dir):
    """Samples of a key-value store."""
    at, made = stored(spark, sf_dir, 2)
    made.count()
    return keyvalue.key_values(spark, at).select("key", "label", F.col("payload").cast("string").alias("payload"))


@query("SELECT count(*) AS entries, count(DISTINCT label) AS num_classes FROM embeddings")
def sink_lmdb(spark, sf_dir):
    """One store, and what it says of itself."""
    at, made = stored(spark, sf_dir, 1)
    made.count()
    return spark.createDataFrame([(f["len"], f["num_classes"]) for f in keyvalue.facts(at)], "entries long, num_classes long")


@query("SELECT CAST(least(4, count(*)) AS BIGINT) AS stores, CAST(sum(400 * (4 + length(CAST(vec_id AS VARCHAR)) + vec_id % 7)) AS BIGINT) AS n_bytes FROM embeddings")
def sink_lmdb_large(spark, sf_dir):
    """Several stores by ranges of keys, with values on pages of their own."""
    at, made = stored(spark, sf_dir, 4, 400)
    count = made.count()
    return keyvalue.key_values(spark, at).agg(F.lit(count).cast("long").alias("stores"), F.sum(F.octet_length("payload").cast("long")).alias("n_bytes"))


def array_rows(spark, sf_dir):
    at = place(spark, "array")
    shards.write_array(base.vectors(spark, sf_dir).select(F.col("vec_id").alias("idx"), "v"), at, 64)
    return shards.read_array(spark, at).select("idx", (F.round(F.col("v")[0], 6) + 0.0).alias("first"))


FIRST = f"WITH {E} SELECT vec_id AS idx, {r6('v[1]')} AS first FROM e"


@query(FIRST)
def scan_zarr(spark, sf_dir):
    """Rows of a chunked array."""
    return array_rows(spark, sf_dir)


@query(FIRST)
def sink_zarr(spark, sf_dir):
    return array_rows(spark, sf_dir)


@query("SELECT CAST(4 AS BIGINT) AS archives, 2 * count(*) AS members FROM embeddings")
def sink_wds(spark, sf_dir):
    """Samples as tar shards: how many members they hold."""
    rows = payloads(spark, sf_dir).withColumn("key", F.lpad(F.col("idx").cast("string"), 8, "0"))
    members = rows.select("key", F.lit("img").alias("kind"), F.col("payload").alias("content")).union(rows.select("key", F.lit("cls"), F.col("label").cast("string").cast("binary")))
    return files.write_archives(members, place(spark, "tar"), 4).agg(F.count("*").alias("archives"), F.sum("members").alias("members"))


@query("SELECT f AS format, (SELECT count(*) FROM embeddings) AS n FROM (VALUES ('recordio'), ('mds'), ('parquet')) t(f)")
def sink_all_formats(spark, sf_dir):
    """One collection in several formats, counted as each reads it."""
    rows = payloads(spark, sf_dir)
    at = place(spark, "parquet")
    rows.write.parquet(at)
    counted = {"recordio": spark.read.format("recordio").load(records(spark, sf_dir)), "mds": shard_rows(spark, sf_dir), "parquet": spark.read.parquet(at)}
    made = [df.agg(F.lit(name).alias("format"), F.count("*").alias("n")) for name, df in counted.items()]
    return made[0].union(made[1]).union(made[2])


def class_folders(spark, sf_dir):
    """A folder of a file for each row, in folders by class."""
    at = place(spark, "folder")

    def run(batches):
        import os

        for batch in batches:
            for idx, label, content in batch[["idx", "label", "payload"]].itertuples(index=False):
                folder = f"{at.removeprefix('file:')}/class{int(label):03d}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/f{idx}.jpg", "wb") as f:
                    f.write(content)
            yield batch[["idx"]]

    payloads(spark, sf_dir).mapInPandas(run, "idx long").count()
    return at


@query("SELECT 'f' || vec_id || '.jpg' AS name, vec_id AS number, CAST(4 + length(CAST(vec_id AS VARCHAR)) + vec_id % 7 AS BIGINT) AS n_bytes FROM embeddings")
def list_files(spark, sf_dir):
    """All files below a folder, by the number in their names."""
    found = files.listed(spark, class_folders(spark, sf_dir), "*.jpg")
    return found.select("name", F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("number"), F.col("length").alias("n_bytes")).orderBy("number")


@query("SELECT 'f' || vec_id || '.jpg' AS name, CAST(label AS BIGINT) AS label FROM embeddings")
def scan_folder_cached(spark, sf_dir):
    """The listing of a folder, kept as Parquet; the second read does not list it again."""
    root, cache = class_folders(spark, sf_dir), place(spark, "listing")
    files.folder_cached(spark, root, cache)
    again = files.folder_cached(spark, root + "-gone", cache)
    return again.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("label").cast("long").alias("label"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_async_sink(spark, sf_dir):
    """Rows of a stream appended batch by batch to a table of metrics."""
    at, state = place(spark, "sink"), place(spark, "state")
    rows = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parquet*")
    sink = files.metrics_sink(at)
    q = stream.select("event_type").writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(at).groupBy("event_type").agg(F.count("*").alias("n"))
