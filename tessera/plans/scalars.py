"""Queries over vectors, losses, strings, samples and sets, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses, vectors as vec
from ..functions.vectors import rounded
from . import base
from .base import E, r6
from .registry import query, table

ITEMS = "unnest(list_transform(range(1, len(w) + 1), lambda k: {'d': k, 'x': w[k]}))"


def long_form(df, vector):
    """(vec_id, d, x): one row per component, from 1."""
    return df.select("vec_id", F.posexplode(vector).alias("d", "x")).select("vec_id", (F.col("d") + 1).cast("long").alias("d"), rounded("x").alias("x"))


def long_sql(expression: str, more: str = "") -> str:
    return f"WITH {E}, u AS (SELECT vec_id, {expression} AS w FROM e {more}), x AS (SELECT vec_id, unnest(range(1, len(w) + 1)) AS d, w FROM u) SELECT vec_id, CAST(d AS BIGINT) AS d, {r6('w[d]')} AS x FROM x"


@query(long_sql("list_transform(range(1, 65), lambda k: v[k] + v[65 - k])"))
def vec_add(spark, sf_dir):
    e = base.vectors(spark, sf_dir)
    return long_form(e, vec.added("v", F.reverse("v")))


@query(f"WITH {E} SELECT vec_id, {r6('greatest(sqrt(list_dot_product(v, v)), 1e-12)')} AS norm FROM e")
def vec_l2norm(spark, sf_dir):
    return base.vectors(spark, sf_dir).select("vec_id", rounded(F.greatest(vec.norm("v"), F.lit(1e-12))).alias("norm"))


@query(long_sql("list_transform(v, lambda x: x * (vec_id % 3) / CASE WHEN vec_id % 3 = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) * (vec_id % 3) END)"))
def vec_normalize(spark, sf_dir):
    """Vectors scaled by 0, 1 or 2 and brought to unit length; zero vectors stay zero."""
    e = base.vectors(spark, sf_dir).withColumn("w", vec.scaled("v", F.col("vec_id") % 3))
    return long_form(e, vec.normalized("w"))


def neighbours(spark, sf_dir):
    e = base.vectors(spark, sf_dir)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


NEXT = f"WITH {E}, n AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


@query(f"{NEXT} SELECT vec_id, {r6('list_dot_product(v, w)')} AS dot FROM n")
def vec_dot(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", rounded(vec.dot("v", "w")).alias("dot"))


@query(f"{NEXT} SELECT vec_id, {r6('list_cosine_similarity(v, w)')} AS cosine, list_cosine_similarity(v, w) > 0.3 AS is_match FROM n")
def vec_cosine(spark, sf_dir):
    c = vec.cosine("v", "w")
    return neighbours(spark, sf_dir).select("vec_id", rounded(c).alias("cosine"), (c > 0.3).alias("is_match"))


@query(f"{NEXT} SELECT vec_id, {r6('power(list_distance(v, w), 2)')} AS sqdist FROM n")
def vec_sqdist(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", rounded(vec.sqdist("v", "w")).alias("sqdist"))


@query(f"{NEXT} SELECT vec_id, {r6('power(list_sum(list_transform(range(1, 65), lambda k: power(abs(v[k] - w[k]), 3))), 1.0 / 3)')} AS pdist3, {r6('list_sum(list_transform(range(1, 65), lambda k: abs(v[k] - w[k])))')} AS pdist1 FROM n")
def vec_pdist(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", rounded(vec.pdist("v", "w", 3)).alias("pdist3"), rounded(vec.pdist("v", "w", 1)).alias("pdist1"))


@query(long_sql("list_transform(v, lambda x: x * ((vec_id % 7) + 1) / 8.0)"))
def vec_scale(spark, sf_dir):
    e = base.vectors(spark, sf_dir)
    return long_form(e, vec.scaled("v", (F.col("vec_id") % 7 + 1) / F.lit(8.0)))


@query(long_sql("list_transform(v, lambda x: round(x, 3))"))
def vec_requantize(spark, sf_dir):
    return long_form(base.vectors(spark, sf_dir), vec.requantized("v", 3))


@query(long_sql("list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * least(1.0, greatest(1e-6, (vec_id % 11) / 10.0 * ((vec_id % 7) + 1) / 8.0)))"))
def vec_quality_norm(spark, sf_dir):
    """Unit vectors with the norm of a quality, held between 1e-6 and 1."""
    e = base.vectors(spark, sf_dir)
    quality = vec.clipped((F.col("vec_id") % 11) / F.lit(10.0) * (F.col("vec_id") % 7 + 1) / F.lit(8.0), 1e-6, 1.0)
    return long_form(e, vec.scaled(vec.normalized("v"), quality))


@query(f"WITH {E} SELECT vec_id, {r6('list_avg(list_transform(range(0, 5), lambda k: sqrt(power(v[2*k+1] - v[2*k+11], 2) + power(v[2*k+2] - v[2*k+12], 2)))) / sqrt(abs((v[21] - v[23]) * (v[22] - v[24])) + 1e-3)')} AS nme FROM e")
def pt_nme(spark, sf_dir):
    """Mean distance of five points from their five others over the side of a box."""
    v = F.col("v")
    dists = [F.sqrt(F.pow(v[2 * k] - v[2 * k + 10], 2) + F.pow(v[2 * k + 1] - v[2 * k + 11], 2)) for k in range(5)]
    side = F.sqrt(F.abs((v[20] - v[22]) * (v[21] - v[23])) + 1e-3)
    return base.vectors(spark, sf_dir).select("vec_id", rounded(sum(dists[1:], dists[0]) / 5 / side).alias("nme"))


AFFINE = "(v[11] + 2) AS a, v[12] AS b, v[13] AS tx, v[14] AS c, (v[15] + 2) AS d, v[16] AS ty"


@query(f"WITH {E}, t AS (SELECT vec_id, v, {AFFINE} FROM e), k AS (SELECT *, unnest(range(0, 5)) AS k FROM t) SELECT vec_id, CAST(k AS BIGINT) AS point, {r6('(d * (v[2*s+1] - tx) - b * (v[2*s+2] - ty)) / (a * d - b * c)')} AS x, {r6('(a * (v[2*s+2] - ty) - c * (v[2*s+1] - tx)) / (a * d - b * c)')} AS y FROM (SELECT *, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE k END AS s FROM k)")
def pt_affine(spark, sf_dir):
    """Points under the inverse of a 2x3 map, with left and right ones swapped as in a mirror."""
    v = F.col("v")
    a, b, tx, c, d, ty = v[10] + 2, v[11], v[12], v[13], v[14] + 2, v[15]
    det = a * d - b * c
    points = [F.struct(F.lit(k).cast("long").alias("point"), rounded((d * (v[2 * s] - tx) - b * (v[2 * s + 1] - ty)) / det).alias("x"), rounded((a * (v[2 * s + 1] - ty) - c * (v[2 * s] - tx)) / det).alias("y")) for k, s in enumerate((1, 0, 2, 4, 3))]
    return base.vectors(spark, sf_dir).select("vec_id", F.inline(F.array(*points)))


@query(f"WITH {E}, x AS (SELECT vec_id, unnest(range(0, 8)) AS c FROM e) SELECT vec_id, CAST(c AS BIGINT) AS c, {r6('(((vec_id * 31 + c * 7) % 256) / 255.0 - 0.5) / 0.5')} AS x FROM x")
def img_normalize(spark, sf_dir):
    e = base.vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("c"))
    return e.select("vec_id", "c", rounded(((F.col("vec_id") * 31 + F.col("c") * 7) % 256 / 255.0 - 0.5) / 0.5).alias("x"))


@query(long_sql("list_reverse(v)"))
def img_flip(spark, sf_dir):
    return long_form(base.vectors(spark, sf_dir), F.reverse("v"))


@query(f"{NEXT} SELECT vec_id, least(49, greatest(0, CAST(floor((round(list_dot_product(v, w), 9) + 0.2) * 50 / 0.4) AS BIGINT))) AS bin FROM n")
def bin_index(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", vec.bin_index(F.round(vec.dot("v", "w"), 9), -0.2, 0.2, 50).alias("bin"))


COS = f"{NEXT}, c AS (SELECT vec_id, list_dot_product(v, w) AS c, vec_id % 3 = 0 AS t, sqrt(list_dot_product(v, v)) * (1 + vec_id % 5) AS n FROM n)"


def cosines(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", vec.dot("v", "w").alias("c"), (F.col("vec_id") % 3 == 0).alias("t"), (vec.norm("v") * (1 + F.col("vec_id") % 5)).alias("n"))


@query(f"{COS} SELECT vec_id, {r6('64 * cos(acos(least(1, greatest(-1, c))) + 0.5)')} AS logit FROM c")
def margin_arcface(spark, sf_dir):
    return cosines(spark, sf_dir).select("vec_id", rounded(losses.arcface("c", 0.5, 64.0)).alias("logit"))


@query(f"{COS} SELECT vec_id, {r6('64 * (c - 0.4)')} AS logit FROM c")
def margin_cosface(spark, sf_dir):
    return cosines(spark, sf_dir).select("vec_id", rounded(losses.cosface("c", 0.4, 64.0)).alias("logit"))


@query(f"{COS} SELECT vec_id, {r6('64 * CASE WHEN t THEN cos(acos(least(1, greatest(-1, c))) * 1.0 + 0.3) - 0.2 WHEN c > 0.05 THEN 0 ELSE c END')} AS logit FROM c")
def margin_combined(spark, sf_dir):
    return cosines(spark, sf_dir).select("vec_id", rounded(losses.combined("c", "t", 64.0, 1.0, 0.3, 0.2, 0.05)).alias("logit"))


@query(f"{COS}, m AS (SELECT avg(n) AS mu, stddev_samp(n) AS sd FROM c), z AS (SELECT vec_id, least(0.999, greatest(-0.999, c)) AS k, t, least(1, greatest(-1, (least(100, greatest(0.001, n)) - mu) / (sd + 0.001) * 0.333)) AS z FROM c, m) SELECT vec_id, {r6('64 * CASE WHEN t THEN cos(least(pi() - 0.001, greatest(0.001, acos(k) - 0.4 * z))) - (0.4 + 0.4 * z) ELSE k END')} AS logit FROM z")
def margin_adaface(spark, sf_dir):
    c = cosines(spark, sf_dir)
    stats = c.agg(F.avg("n").alias("mu"), F.stddev_samp("n").alias("sd"))
    return c.join(F.broadcast(stats)).select("vec_id", rounded(losses.adaface("c", "t", "n", "mu", "sd")).alias("logit"))


@query(f"{COS} SELECT vec_id, {r6('CASE WHEN vec_id % 2 = 0 THEN sign(least(1, greatest(-1, least(n, 3 - n)))) ELSE 1 - cos(least(1, greatest(-1, (n + 3 - n) / 2)) * pi() / 2) END')} AS weight, {r6('least(1, greatest(-1, greatest(n, 3 - n)))')} AS weight_linear FROM c")
def quality_weight(spark, sf_dir):
    other = 3 - F.col("n")
    sign, cosine = losses.quality_weight("n", other, "low", "sgn"), losses.quality_weight("n", other, "mean", "cos")
    return cosines(spark, sf_dir).select("vec_id", rounded(F.when(F.col("vec_id") % 2 == 0, sign).otherwise(cosine)).alias("weight"), rounded(losses.quality_weight("n", other, "max", "linear")).alias("weight_linear"))


ANCHORS = [(-0.2, 0.0), (-0.05, 0.1), (0.05, 0.5), (0.2, 1.0)]
ANCHOR_SQL = "a(x, y) AS (VALUES " + ", ".join(f"(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for x, y in ANCHORS) + "), g AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM a)"


@query(f"{COS}, {ANCHOR_SQL} SELECT vec_id, {r6('CASE WHEN x2 IS NULL THEN y ELSE y + (c - x) / (x2 - x) * (y2 - y) END')} AS mapped FROM c LEFT JOIN g ON c >= x AND (c < x2 OR x2 IS NULL)")
def calibrate_interp(spark, sf_dir):
    """A score mapped between two scales by straight lines between anchors: null below the first, the last value above the last."""
    c = F.col("c")
    made = F.lit(None).cast("double")
    for (x, y), (x2, y2) in zip(ANCHORS, ANCHORS[1:], strict=False):
        made = F.when((c >= x) & (c < x2), y + (c - x) / (x2 - x) * (y2 - y)).otherwise(made)
    return cosines(spark, sf_dir).select("vec_id", rounded(F.when(c >= ANCHORS[-1][0], F.lit(ANCHORS[-1][1])).otherwise(made)).alias("mapped"))


@query(f"{COS}, b(t0, name) AS (VALUES (-0.1, 'low'), (0.0, 'middle'), (0.1, 'high')) SELECT vec_id, max_by(name, t0) AS band FROM c LEFT JOIN b ON c >= t0 GROUP BY vec_id")
def band_label(spark, sf_dir):
    """The deepest level whose threshold a score reaches."""
    c = F.col("c")
    return cosines(spark, sf_dir).select("vec_id", F.when(c >= 0.1, "high").when(c >= 0.0, "middle").when(c >= -0.1, "low").alias("band"))


STEPS = "s AS (SELECT CAST(unnest(range(0, 100)) AS BIGINT) AS step)"


def steps(spark, n=100):
    return spark.range(n).select(F.col("id").alias("step"))


@query(f"WITH {STEPS} SELECT step, {r6('CASE WHEN step < 10 THEN 0.1 * step / 10 ELSE 0.1 * power(1 - (step - 10) / 90.0, 2) END')} AS lr FROM s")
def lr_poly(spark, sf_dir):
    return steps(spark).select("step", rounded(losses.poly("step", 10, 100, 0.1, 2)).alias("lr"))


@query(f"WITH {STEPS} SELECT step, {r6('CASE WHEN step < 10 THEN 0.1 * step / 10 ELSE 0.1 * power(0.1, (step >= 40)::INT + (step >= 70)::INT) END')} AS lr FROM s")
def lr_step(spark, sf_dir):
    return steps(spark).select("step", rounded(losses.stepped("step", 10, 0.1, (40, 70), 0.1)).alias("lr"))


@query(f"WITH {STEPS} SELECT step, {r6('CASE WHEN step < 10 THEN 0.1 * step / 10 ELSE 0.001 + 0.5 * (0.1 - 0.001) * (1 + cos(pi() * (step - 10) / 90.0)) END')} AS lr FROM s")
def lr_cosine(spark, sf_dir):
    return steps(spark).select("step", rounded(losses.cosine_decay("step", 10, 100, 0.1, 0.001)).alias("lr"))


@query(f"WITH {STEPS} SELECT step, {r6('1 - (1 - 0.3) * least(1.0, step / 50.0)')} AS ratio FROM s")
def st_warmup(spark, sf_dir):
    return steps(spark).select("step", rounded(losses.annealed("step", 50, 0.3)).alias("ratio"))


# Strings, maps and JSON


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') || '.jpg' AS renamed FROM pages")
def str_basename(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("name", F.element_at(F.split("url", "/"), -1))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return p.select("page_id", "name", stem.alias("stem"), F.concat(stem, F.lit(".jpg")).alias("renamed"))


@query("SELECT c_custkey, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number, split_part(c_name, '#', 1) AS prefix FROM customer")
def str_prefix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long").alias("number"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"))


@query("SELECT c_custkey, left(c_name, 3) || repeat('*', greatest(length(c_name) - 5, 0)) || right(c_name, 2) AS masked FROM customer")
def str_mask(spark, sf_dir):
    n = F.length("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.left("c_name", F.lit(3)), F.repeat(F.lit("*"), F.greatest(n - 5, F.lit(0))), F.right("c_name", F.lit(2))).alias("masked"))


@query("SELECT page_id, replace(replace(regexp_replace(url, '/$', ''), '/', '_'), '@', '_at_') AS flat FROM pages")
def str_flatten(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.replace(F.regexp_replace("url", "/$", ""), F.lit("/"), F.lit("_")), F.lit("@"), F.lit("_at_")).alias("flat"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS epoch FROM pages")
def str_epoch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1), F.lit("")).cast("long").alias("epoch"))


@query("WITH t AS (SELECT unnest(string_split('1e-1:0.10,1e-2:0.25,1e-3:0.4', ',')) AS x) SELECT CAST(split_part(x, ':', 1) AS DOUBLE) AS far, CAST(split_part(x, ':', 2) AS DOUBLE) AS threshold FROM t")
def str_levels(spark, sf_dir):
    parts = F.explode(F.split(F.lit("1e-1:0.10,1e-2:0.25,1e-3:0.4"), ","))
    return spark.range(1).select(parts.alias("x")).select(F.split_part("x", F.lit(":"), F.lit(1)).cast("double").alias("far"), F.split_part("x", F.lit(":"), F.lit(2)).cast("double").alias("threshold"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.n') AS BIGINT) AS n FROM events")
def json_scalars(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.n").cast("long").alias("n"))


@query("SELECT n_nationkey, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def folder_mapping(spark, sf_dir):
    """Each child's parent, by a dimension table of a few rows."""
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("parent"))
    return table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "parent")


@query(f"WITH {E} SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS greatest_at, {r6('list_max(v)')} AS greatest, {r6('list_sum(list_concat(v[1:3], list_reverse(v)[1:3]))')} AS ends FROM e")
def arr_argmax(spark, sf_dir):
    e = base.vectors(spark, sf_dir)
    ends = F.concat(F.slice("v", 1, 3), F.slice(F.reverse("v"), 1, 3))
    return e.select("vec_id", vec.argmax("v", 1, 64).alias("greatest_at"), rounded(F.array_max("v")).alias("greatest"), rounded(vec.total(ends)).alias("ends"))


@query("SELECT CAST(k AS BIGINT) AS k, (round(log2(k + 1), 6) + 0.0) AS log2, CAST(floor(k / 7.0) AS BIGINT) AS low, CAST(ceil(k / 7.0) AS BIGINT) AS high, (round(exp(-k / 10.0), 6) + 0.0) AS e, (round(-1 + k * 2.0 / 99, 6) + 0.0) AS grid, (round(acos(cos(k / 40.0)), 6) + 0.0) AS angle FROM (SELECT unnest(range(0, 100)) AS k)")
def math_scalars(spark, sf_dir):
    k = F.col("id")
    return spark.range(100).select(k.alias("k"), rounded(F.log2(k + 1)).alias("log2"), F.floor(k / 7.0).alias("low"), F.ceil(k / 7.0).alias("high"), rounded(F.exp(-k / 10.0)).alias("e"), rounded(-1 + k * 2.0 / 99).alias("grid"), rounded(F.acos(F.cos(k / 40.0))).alias("angle"))
