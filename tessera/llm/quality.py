"""Rules on texts, judged by host too, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hosts up to this many are broadcast (a row of a host is under 200 bytes); more are joined salted.
MOST_BROADCAST_HOSTS = 100_000
SALTS = 32
SPACES = r"[\x20\x09-\x0D]+"


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of the whole text (null: empty).

    A window of three words is known by a 64-bit hash within its own text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    step = docs.withColumn("_body", body)
    step = step.withColumn("_words", F.filter(F.split("_body", SPACES), lambda w: w != ""))
    step = step.withColumn("_lines", F.filter(F.split("_body", "\n"), has_word))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("word_chars", F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
    step = step.withColumn("n_symbols", F.length(F.regexp_replace("_body", r"[^#*$%&|<>]+", "")).cast("long"))
    step = step.withColumn("n_lines", F.size("_lines").cast("long"))
    step = step.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines", "_body")
    # Windows sorted by hash stand beside their equals; those that have one are put in the order of the text.
    step = step.withColumn("_hashes", F.when(F.col("n_words") > 2, F.zip_with(F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("_words", 3, F.size("_words")), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))).otherwise(F.array().cast("array<bigint>"))).drop("_words")
    step = step.withColumn("_sorted", F.sort_array(F.transform(F.slice("_hashes", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("_hashes")
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))
    size = F.size("_sorted")
    step = step.withColumn("_beside", F.zip_with("_sorted", F.concat(F.array(none), F.slice("_sorted", 1, F.greatest(size - 1, F.lit(0)))), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), (x["h"] == y["h"]).alias("before"))))
    step = step.withColumn("_beside", F.zip_with("_beside", F.slice("_sorted", 2, F.greatest(size, F.lit(1))), lambda x, y: F.when(F.coalesce(x["before"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))).drop("_sorted")
    step = step.withColumn("_found", F.sort_array(F.filter("_beside", lambda i: i.isNotNull()))).drop("_beside")
    # Each found window covers three words, less those that the next one covers too.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return step.withColumn("n_repeat_words", F.aggregate("_found", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])).drop("_found")


def own_failure() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def method_failure() -> Column:
    """The base rules, and the method's own: more than one symbol a word, a mean word under 2 or over 15 characters, over half of the lines duplicates of earlier ones."""
    length = (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    return own_failure() | (F.col("n_symbols") > F.col("n_words")) | length | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def host_verdicts(judged: DataFrame, host: str, failed: str, most_rate: float = 0.5) -> DataFrame:
    """(host, n, failures, rate, host_kept): each host's failure rate, shrunk towards all hosts' rates.

    The prior is a beta distribution by the method of moments over the hosts' rates, weighted by rows, with a weight of
    1 to 1000 rows; a host is rejected if its posterior mean rate is over `most_rate`. Rows without a host have none.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    total = F.sum("n")
    prior = hosts.agg((F.sum("failures") / total).alias("mean"), (F.sum(F.col("failures") * F.col("failures") / F.col("n")) / total - F.pow(F.sum("failures") / total, 2)).alias("spread"), (F.count("*") / total).alias("share"))
    inside = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest((F.col("spread") - inside * F.col("share")) / F.greatest(1 - F.col("share"), F.lit(1e-9)), inside / 1001)
    prior = prior.select("mean", F.when(inside <= 0, F.lit(1000.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), inside / between - 1))).alias("weight"), F.lit(1).alias("_one"))
    shrunk = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one")
    shrunk = shrunk.withColumn("rate", (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")))
    return shrunk.select("host", "n", "failures", "rate", (F.col("rate") <= most_rate).alias("host_kept"))


def join_hosts(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """rows with their host's columns, by a broadcast if the hosts are counted few, else by salted keys."""
    if hosts.count() <= MOST_BROADCAST_HOSTS:
        return rows.join(F.broadcast(hosts), rows[host] == hosts["host"], "left").drop(hosts["host"])
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (rows[host] == salted["host"]) & (rows["_row_salt"] == salted["_salt"]), "left").drop("_salt", "_row_salt", "host")


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source", most_rate: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, host_rate, kept, method_failed, method_kept.

    kept is false if the text fails the base rules, else its host's verdict by them, as the SQL states it; method_kept is the same
    by all rules, for texts and hosts alike. A row without a host keeps its own. Null texts are empty and fail. Equal rows each come out. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("_host"))
    judged = cut(text_measures(rows).drop("text").withColumn("base_failed", own_failure()).withColumn("method_failed", method_failure()))
    base = host_verdicts(judged, "_host", "base_failed", most_rate)
    method = host_verdicts(judged, "_host", "method_failed", most_rate).select("host", F.col("host_kept").alias("method_host_kept"))
    joined = join_hosts(judged, cut(base.join(method, "host")), "_host")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("rate", 9).alias("host_rate"), (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "method_failed", (~F.col("method_failed") & F.coalesce("method_host_kept", F.lit(True))).alias("method_kept"))


def filtered(docs: DataFrame, text: str = "text", host: str = "source", most_rate: float = 0.5) -> DataFrame:
    """The rows of docs whose method_kept of quality() is true, with their columns."""
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("_host"))
    judged = cut(text_measures(rows).select("_row", "_host", "n_words", "word_chars", "n_symbols", method_failure().alias("method_failed")))
    hosts = cut(host_verdicts(judged, "_host", "method_failed", most_rate))
    joined = join_hosts(judged.where(~F.col("method_failed")), hosts, "_host")
    return joined.where(F.coalesce("host_kept", F.lit(True))).select("_row.*")
