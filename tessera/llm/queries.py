"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, neighbours, packing, pieces, quality, repeats, secrets, sharding, simhash, tokens
from .common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("n_crf", "redacted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("host_rate", "method_failed", "method_kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.checksum(table(spark, sf_dir, "documents"), pieces.model_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.tokenizer_path()).drop("n_loss")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_neighbours, op2_secrets, op3_licenses, op4_quality_rules, op5_token_counts, op6_repeats, op7_simhash, op8_sharding, op9_sentencepiece, op10_packing)}

_BODY = "b AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents), w AS (SELECT rid, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS word FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM b))"

SQL: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH {_BODY},
t AS (SELECT rid, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS three FROM w WINDOW d AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS n FROM t WHERE three IS NOT NULL) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS i FROM f) GROUP BY rid),
c AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM b),
m AS (SELECT b.rid, doc_id, source, coalesce(c.n, 0) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM b LEFT JOIN c USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM j WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, sum(k * k * 1.0 / n) / sum(n) - power(sum(k) / sum(n), 2) AS spread, count(*) / sum(n) AS share FROM h),
q AS (SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1000 ELSE greatest(1, least(1000, mean * (1 - mean) / greatest((spread - mean * (1 - mean) * share) / greatest(1 - share, 1e-9), mean * (1 - mean) / 1001) - 1)) END AS weight FROM p),
v AS (SELECT source, (k + mean * weight) / (n + weight) <= 0.5 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept FROM j LEFT JOIN v USING (source)""",
    "op6_repeats": rf"""
WITH {_BODY},
s AS (SELECT rid, i, string_agg(word, ' ') OVER d AS passage, count(*) OVER d AS n FROM w WINDOW d AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY passage) AS k FROM s WHERE n = 35) WHERE k > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM f),
k AS (SELECT w.rid, count(*) AS n, count(*) FILTER (g.i IS NULL) AS kept, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS t FROM w LEFT JOIN g ON g.rid = w.rid AND g.i = w.i GROUP BY w.rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n - kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM b LEFT JOIN k USING (rid)""",
}
