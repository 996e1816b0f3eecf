"""Queries over samples, histories, sets, graphs, queues and windows of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalized, rounded
from ..operators import graph
from ..operators import history as hist
from ..operators import sampling
from ..operators import similarity as sim
from ..operators.pooling import pooled
from . import base
from .base import E, P, r6
from .registry import query, table

# Filters and samples


@query(f"WITH {E}, k AS (SELECT vec_id, label FROM e WHERE vec_id % 10 <> 3 AND label <> 4) SELECT vec_id, label, dense_rank() OVER (ORDER BY label) - 1 AS dense FROM k")
def subset_drop(spark, sf_dir):
    """Rows without an index set and without a class, with labels numbered densely again."""
    e = base.vectors(spark, sf_dir).select("vec_id", "label")
    dropped = e.where("vec_id % 10 = 3 or label = 4").select("vec_id")
    return sampling.dense_labels(e.join(dropped, "vec_id", "left_anti"), "label", "dense")


@query("SELECT vec_id, vec_id % 4 = 0 AS quarter FROM embeddings WHERE vec_id % 2 = 0")
def resample_stride(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("pmod(vec_id, 2) = 0").select("vec_id", (F.pmod("vec_id", F.lit(4)) == 0).alias("quarter"))


@query("WITH m AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, id FROM documents JOIN m USING (source)")
def label_remap(spark, sf_dir):
    return sampling.dense_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "id").select("doc_id", "id")


@query("WITH w AS (SELECT item_id * 30 + 1 AS k FROM benchmark) SELECT k AS name, vec_id, vec_id IS NULL AS missing FROM w LEFT JOIN embeddings ON vec_id = k - 1")
def subset_list(spark, sf_dir):
    """Rows named in a list, whose names count from 1; names without a row are reported."""
    names = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 30 + 1).alias("name"))
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return names.join(e, F.col("vec_id") == F.col("name") - 1, "left").select("name", "vec_id", F.col("vec_id").isNull().alias("missing"))


@query(f"WITH {P} SELECT i, j FROM p WHERE s > 0.3 AND NOT same")
def pair_predicate(spark, sf_dir):
    return sim.pairs_where(base.labelled(spark, sf_dir), neg_from=0.3).where("score > 0.3").select("i", "j")


HISTORY = "hist AS (SELECT user_id % 20 AS run, CAST(date_diff('hour', TIMESTAMP '2020-01-01', ts) // 24 AS BIGINT) AS step, round(avg(value) FILTER (event_type = 'click'), 6) AS m1, round(avg(value) FILTER (event_type = 'view'), 6) AS m2, count(*) AS n FROM events GROUP BY 1, 2)"


def metric_history(spark, sf_dir):
    """(run, step, m1, m2, n): metrics of runs by day; a metric is null where nothing was measured."""
    e = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2020-01-01 00:00:00', ts)")
    of = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)
    return e.groupBy((F.col("user_id") % 20).alias("run"), F.floor(hours / 24).alias("step")).agg(of("click").alias("m1"), of("view").alias("m2"), F.count("*").alias("n"))


@query(f"WITH {HISTORY} SELECT run, step, m1 IS NULL AS missing1, m2 IS NULL OR isnan(m2) AS missing2 FROM hist")
def is_missing(spark, sf_dir):
    m = metric_history(spark, sf_dir)
    return m.select("run", "step", hist.missing("m1").alias("missing1"), hist.missing("m2").alias("missing2"))


@query(f"WITH {HISTORY} SELECT run, step, m1, m2 FROM hist WHERE NOT (m1 IS NULL AND m2 IS NULL)")
def drop_all_null(spark, sf_dir):
    return metric_history(spark, sf_dir).na.drop(how="all", subset=["m1", "m2"]).select("run", "step", "m1", "m2")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def column_prefix_select(spark, sf_dir):
    """Columns that begin with a prefix, but not with another."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*hist.by_prefix(rows.columns, keep=("l_orderkey", "l_linenum", "l_ship"), drop=("l_shipm", "l_shipi")))


@query("SELECT n_nationkey AS eval_nationkey, n_name AS eval_name, n_regionkey AS eval_regionkey FROM nation")
def rename_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return rows.withColumnsRenamed({c: "eval_" + c.removeprefix("n_") for c in rows.columns})


@query()
def debug_limit(spark, sf_dir):
    """A sample run: ten batches of 32 rows, in index order."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(320).select("vec_id", "label")


KEY = "(vec_id * 2654435761 + {} * 40503) % 1000003"


@query(f"WITH {E}, c AS (SELECT a.vec_id, b.vec_id AS chosen, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.vec_id * 2654435761 + b.vec_id * 40503) % 1000003, b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, chosen FROM c WHERE r = 1")
def sample_same_label(spark, sf_dir):
    """One other row of the same label for each row, by the least key."""
    return sampling.least_partners(base.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", "label")


CAPPED = f"{E}, sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1), cap AS (SELECT label, n, least(CAST(floor(100 * ln(n) / ln(2)) AS BIGINT), 10000) AS cap FROM sizes)"


@query(f"WITH {CAPPED}, pp AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.label ORDER BY (a.vec_id * 2654435761 + b.vec_id * 40503) % 1000003, a.vec_id, b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, i, j FROM pp JOIN cap USING (label) WHERE r <= cap")
def sample_pairs_adaptive(spark, sf_dir):
    """Positive pairs of each class up to floor(100 log2 n), at most 10000, by a key of the pair."""
    return sampling.positive_pairs(base.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", "label")


NEGATIVE = f"""
WITH {CAPPED}, t AS (SELECT count(*) AS total FROM e),
f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM cap),
m AS (SELECT label, n, first, unnest(range(0, CASE WHEN n < 2 THEN 100 ELSE 10 * least(n * (n - 1) // 2, cap) END)) AS k FROM f),
d AS (SELECT label, first + (k * 7919 + label) % n AS r, first, n, (k * 104729 + label * 31) % (total - n) AS d FROM m, t WHERE n < total),
o AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS g FROM e)
SELECT d.label, count(*) AS n, count(*) FILTER (o.label = d.label) AS wrong, CAST(sum(a.vec_id * 31 + o.vec_id) AS BIGINT) AS keys
FROM d JOIN o AS a ON a.g = d.r JOIN o ON o.g = CASE WHEN d.d < d.first THEN d.d ELSE d.d + d.n END GROUP BY 1"""


@query(NEGATIVE)
def sample_negative_pairs(spark, sf_dir):
    """Negative pairs: ten for each positive one, an anchor of the class with a row of any other; no draw is void."""
    return sampling.negative_pairs(base.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("other_label") == F.col("label")).alias("wrong"), F.sum(F.col("anchor") * 31 + F.col("other")).alias("keys"))


@query(f"WITH {E}, u AS (SELECT DISTINCT label % 10 AS c, label IN (1, 3) AS pos FROM e), k AS (SELECT c, row_number() OVER (ORDER BY pos DESC, (c * 2654435761 + 17) % 1000003, c) AS r FROM u) SELECT c AS class, row_number() OVER (ORDER BY c) - 1 AS local FROM k WHERE r <= 5")
def sample_negative_classes(spark, sf_dir):
    """All positive classes, filled up to five with others by a key, numbered again in order."""
    classes = base.vectors(spark, sf_dir).select(F.col("label").alias("class")).distinct()
    order = Window.orderBy(F.desc(F.col("class").isin(1, 3)), (F.col("class") * 2654435761 + 17) % 1000003, "class")
    kept = classes.withColumn("r", F.row_number().over(order)).where("r <= 5")
    return kept.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("long").alias("local"))


@query(f"WITH {E} SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 2654435761 + 42 * 40503) % 1000003, vec_id) - 1 AS place FROM e")
def shuffle_epoch(spark, sf_dir):
    """A permutation that follows from the epoch's seed."""
    return sampling.permuted(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 42)


# Sorts, limits and windows


@query("WITH d AS (SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0) SELECT DISTINCT vec_id, label FROM d")
def sort_index_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"))
    doubled = e.union(e.where("vec_id % 3 = 0"))
    return doubled.dropDuplicates(["vec_id"]).orderBy("vec_id")


@query("SELECT vec_id, vec_id % 3 AS rank FROM embeddings")
def gather_interleave(spark, sf_dir):
    """Parts of three ranks, with padded duplicates, gathered to one row for each index: the first rank's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("rank"))
    padded = e.union(e.where("vec_id < 3").select("vec_id", F.lit(9).cast("long")))
    return padded.groupBy("vec_id").agg(F.min("rank").alias("rank"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY regexp_replace('f' || p_partkey || '.jpg', '[0-9].*', ''), CAST(p_partkey AS BIGINT)) AS place FROM part")
def sort_natural(spark, sf_dir):
    """Names in the order of their text and then of their number."""
    name = F.concat(F.lit("f"), F.col("p_partkey"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(name, "[0-9].*", "").alias("text"), F.regexp_extract(name, "([0-9]+)", 1).cast("long").alias("number"))
    return sampling.numbered(rows, ["text", "number"], "place", 1).select("p_partkey", "place")


@query(f"WITH {E}, o AS (SELECT vec_id, vec_id % 25 AS template, vec_id % 3 AS media FROM e) SELECT template, media, min(vec_id) AS first, count(*) AS n FROM o GROUP BY 1, 2")
def sort_lex(spark, sf_dir):
    """Runs of rows with one (template, media): where each begins and how long it is."""
    rows = base.vectors(spark, sf_dir).select((F.col("vec_id") % 25).alias("template"), (F.col("vec_id") % 3).alias("media"), "vec_id")
    return rows.groupBy("template", "media").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))


@query(f"WITH {P}, a AS (SELECT i, j, s, 'top' AS side FROM p ORDER BY s DESC, i, j LIMIT 50), b AS (SELECT i, j, s, 'bottom' AS side FROM p ORDER BY s, i, j LIMIT 50) SELECT side, i, j, s + 0.0 AS score FROM a UNION ALL SELECT side, i, j, s + 0.0 FROM b")
def topk_global(spark, sf_dir):
    rows = base.labelled(spark, sf_dir).withColumn("label", F.lit(0))
    top, bottom = sim.extremes(rows, 50, True, True), sim.extremes(rows, 50, True, False)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom"))).select("side", "i", "j", (F.col("score") + 0.0).alias("score"))


@query(f"WITH {P}, l(far, thr) AS (VALUES (CAST(0.01 AS DOUBLE), CAST(0.3 AS DOUBLE)), (CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE))), b AS (SELECT far, i, j, s, CASE WHEN s >= thr THEN 'above' ELSE 'below' END AS side, row_number() OVER (PARTITION BY far, s >= thr ORDER BY round(abs(s - thr), 12), i, j) AS r FROM p, l WHERE NOT same) SELECT far, side, i, j, s + 0.0 AS score FROM b WHERE r <= 100")
def topk_band(spark, sf_dir):
    """The hundred pairs nearest to each level on either side of it."""
    made = sim.nearest_levels(base.labelled(spark, sf_dir), {0.01: 0.3, 0.1: 0.2}, 100)
    return made.select("far", "side", "i", "j", (F.col("score") + 0.0).alias("score"))


@query(f"WITH {P}, t AS (SELECT i, j, s FROM p WHERE NOT same ORDER BY s DESC, i, j LIMIT 30) SELECT i, j, s + 0.0 AS score FROM t")
def topk_merge(spark, sf_dir):
    """The best of each tile, put together and ranked again."""
    return sim.extremes(base.labelled(spark, sf_dir), 30, False, True, block_rows=100).select("i", "j", (F.col("score") + 0.0).alias("score"))


@query(f"WITH {HISTORY}, o AS (SELECT run, m1, row_number() OVER (PARTITION BY run ORDER BY step) AS r FROM hist WHERE m1 IS NOT NULL), RECURSIVE_IN AS (SELECT 1) SELECT run, {r6('sum(m1 * CASE WHEN r = 1 THEN power(0.9, n - 1) ELSE 0.1 * power(0.9, n - r) END)')} AS ema FROM o JOIN (SELECT run, max(r) AS n FROM o GROUP BY 1) USING (run) GROUP BY run")
def win_ema(spark, sf_dir):
    """The moving average m <- a x + (1 - a) m of each run's metric, at its end."""
    return hist.ema(metric_history(spark, sf_dir).where("m1 is not null"), "run", "step", "m1", 0.1).select("run", rounded("ema").alias("ema"))


@query(f"WITH {HISTORY}, o AS (SELECT run, avg(step) AS m, stddev_samp(step) AS sd, count(*) AS n FROM hist GROUP BY 1), r AS (SELECT run, m, sd, row_number() OVER (ORDER BY run) AS r, count(*) OVER () AS t FROM o) SELECT {r6('sum(m * CASE WHEN r = 1 THEN power(0.99, t - 1) ELSE 0.01 * power(0.99, t - r) END)')} AS mean, {r6('sum(sd * CASE WHEN r = 1 THEN power(0.99, t - 1) ELSE 0.01 * power(0.99, t - r) END)')} AS std FROM r")
def st_ema(spark, sf_dir):
    """Moving averages of batch means and sample deviations."""
    batches = metric_history(spark, sf_dir).groupBy("run").agg(F.avg("step").alias("m"), F.stddev_samp("step").alias("sd")).withColumn("one", F.lit(1))
    mean, std = (hist.ema(batches, "one", "run", c, 0.01) for c in ("m", "sd"))
    return mean.select("one", rounded("ema").alias("mean")).join(std.select("one", rounded("ema").alias("std")), "one").select("mean", "std")


STOP = f"{HISTORY}, o AS (SELECT run, step, m1, max(m1) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM hist WHERE m1 IS NOT NULL), b AS (SELECT *, best IS NULL OR m1 > best AS improved FROM o), g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS grp FROM b), c AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY run, grp ORDER BY step) AS waited FROM g)"


@query(f"WITH {STOP} SELECT run, min(step) FILTER (waited >= 5) AS stop_step, {r6('max(m1)')} AS best FROM c GROUP BY run")
def win_early_stop(spark, sf_dir):
    """The step at which a run's metric has not improved five times in a row."""
    made = hist.waits(metric_history(spark, sf_dir).where("m1 is not null"), "run", "step", "m1")
    return made.groupBy("run").agg(F.min(F.when(F.col("waited") >= 5, F.col("step"))).alias("stop_step"), rounded(F.max("m1")).alias("best"))


@query(f"WITH {STOP} SELECT run, step, improved AS is_best FROM c")
def win_best_tracker(spark, sf_dir):
    return hist.waits(metric_history(spark, sf_dir).where("m1 is not null"), "run", "step", "m1").select("run", "step", F.col("improved").alias("is_best"))


@query(f"WITH {STOP}, o2 AS (SELECT run, step, m2, max(m2) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM hist WHERE m2 IS NOT NULL), b2 AS (SELECT *, best IS NULL OR m2 > best AS improved FROM o2), g2 AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS grp FROM b2), c2 AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY run, grp ORDER BY step) AS waited FROM g2), s1 AS (SELECT run, bool_or(waited >= 5) AS s FROM c GROUP BY 1), s2 AS (SELECT run, bool_or(waited >= 5) AS s FROM c2 GROUP BY 1) SELECT run, coalesce(s1.s, false) OR coalesce(s2.s, false) AS stopped FROM s1 FULL JOIN s2 USING (run)")
def win_stop_any(spark, sf_dir):
    """Whether either of two monitors stops a run."""
    h = metric_history(spark, sf_dir)
    each = [hist.waits(h.where(f"{m} is not null"), "run", "step", m).groupBy("run").agg(F.bool_or(F.col("waited") >= 5).alias("s")) for m in ("m1", "m2")]
    return each[0].union(each[1]).groupBy("run").agg(F.bool_or("s").alias("stopped"))


@query(f"WITH {HISTORY}, a AS (SELECT run % 5 AS run, step, run // 5 AS src, m1 FROM hist), b AS (SELECT run, step, m1, src, row_number() OVER (PARTITION BY run, step ORDER BY src) AS r FROM a) SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS new_step, step, src, m1 FROM b WHERE r = 1")
def win_dedup_step(spark, sf_dir):
    """Histories merged step by step: the first source wins, and steps are numbered again."""
    h = metric_history(spark, sf_dir).select((F.col("run") % 5).alias("run"), "step", F.floor(F.col("run") / 5).alias("src"), "m1")
    first = h.groupBy("run", "step").agg(F.min_by(F.struct("src", "m1"), "src").alias("f"))
    number = F.row_number().over(Window.partitionBy("run").orderBy("step")) - 1
    return first.select("run", number.cast("long").alias("new_step"), "step", "f.src", "f.m1")


@query("SELECT vec_id, CAST(ntile(7) OVER (ORDER BY vec_id) AS BIGINT) AS fold FROM embeddings")
def win_fold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return e.select("vec_id", base.fold_of(F.col("vec_id"), F.lit(e.count()), 7).alias("fold"))


@query("SELECT vec_id, vec_id % 3 AS shard, vec_id // 3 AS place FROM embeddings")
def win_shard(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("vec_id", F.lit(3)).alias("shard"), F.floor(F.col("vec_id") / 3).alias("place"))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id, false AS padded FROM embeddings UNION ALL SELECT vec_id, true FROM embeddings, n WHERE vec_id < (7 - n % 7) % 7")
def win_pad_world(spark, sf_dir):
    """The first rows repeated until the world of seven divides the count."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    pad = -e.count() % 7
    return e.select("vec_id", F.lit(False).alias("padded")).unionByName(e.orderBy("vec_id").limit(pad).select("vec_id", F.lit(True).alias("padded")))


@query(f"WITH {HISTORY} SELECT run, step, coalesce(m1, m2, 0) AS metric FROM hist")
def win_step_metric(spark, sf_dir):
    return metric_history(spark, sf_dir).select("run", "step", F.coalesce("m1", "m2", F.lit(0.0)).alias("metric"))


@query("SELECT r_regionkey, CAST(unnest(range(0, 15)) AS BIGINT) AS epoch FROM region")
def row_replicate(spark, sf_dir):
    """A flat baseline: each row repeated for the epochs."""
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("epoch"))


@query("SELECT p_partkey, CAST(ceil(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) / 12.0) AS BIGINT) AS page FROM part")
def win_paginate(spark, sf_dir):
    rows = sampling.numbered(table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_retailprice")).alias("k")), ["k", "p_partkey"], "n", 1)
    return rows.select("p_partkey", F.ceil(F.col("n") / 12).alias("page"))


# Histories


@query(f"WITH {HISTORY}, u AS (SELECT 'm1' AS metric, count(m1) AS n FROM hist UNION ALL SELECT 'm2', count(m2) FROM hist UNION ALL SELECT 'n', count(n) FROM hist) SELECT metric, n FROM u ORDER BY n DESC, metric")
def agg_completeness(spark, sf_dir):
    return hist.completeness(metric_history(spark, sf_dir), ["m1", "m2", "n"])


@query(f"WITH {HISTORY}, u AS (SELECT run, 'm1' AS metric, m1 AS val FROM hist UNION ALL SELECT run, 'm2', m2 FROM hist) SELECT CASE metric WHEN 'm1' THEN 'click' ELSE 'view' END AS metric, {r6('avg(val)')} AS val FROM u WHERE run IN (1, 2, 3) GROUP BY 1")
def agg_summary(spark, sf_dir):
    """Metrics on a list, renamed, and their mean."""
    long = metric_history(spark, sf_dir).unpivot(["run"], ["m1", "m2"], "metric", "val")
    kept = long.join(F.broadcast(spark.range(1, 4).select(F.col("id").alias("run"))), "run", "left_semi")
    return kept.groupBy(F.when(F.col("metric") == "m1", "click").otherwise("view").alias("metric")).agg(rounded(F.avg("val")).alias("val"))


@query(f"WITH {HISTORY} SELECT step, {r6('max(m1) FILTER (run = 0)')} AS run0, {r6('max(m1) FILTER (run = 1)')} AS run1, {r6('max(m1) FILTER (run = 2)')} AS run2, {r6('max(m1) FILTER (run = 3)')} AS run3, {r6('max(m1) FILTER (run = 4)')} AS run4, {r6('max(m1) FILTER (run = 5)')} AS run5, {r6('max(m1) FILTER (run = 6)')} AS run6, {r6('max(m1) FILTER (run = 7)')} AS run7, {r6('max(m1) FILTER (run = 8)')} AS run8, {r6('max(m1) FILTER (run = 9)')} AS run9, {r6('max(m1) FILTER (run = 10)')} AS run10, {r6('max(m1) FILTER (run = 11)')} AS run11, {r6('max(m1) FILTER (run = 12)')} AS run12, {r6('max(m1) FILTER (run = 13)')} AS run13, {r6('max(m1) FILTER (run = 14)')} AS run14, {r6('max(m1) FILTER (run = 15)')} AS run15, {r6('max(m1) FILTER (run = 16)')} AS run16, {r6('max(m1) FILTER (run = 17)')} AS run17, {r6('max(m1) FILTER (run = 18)')} AS run18, {r6('max(m1) FILTER (run = 19)')} AS run19 FROM hist GROUP BY step")
def agg_pivot_models(spark, sf_dir):
    made = metric_history(spark, sf_dir).groupBy("step").pivot("run", list(range(20))).agg(rounded(F.max("m1")))
    return made.toDF("step", *(f"run{i}" for i in range(20)))


@query("SELECT user_id % 50 AS k, arg_max(event_type, event_id) AS setting, max(event_id) AS set_by FROM events GROUP BY 1")
def agg_config_merge(spark, sf_dir):
    """The last value set for each key."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("k")).agg(F.max_by("event_type", "event_id").alias("setting"), F.max("event_id").alias("set_by"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS tags FROM f GROUP BY 1")
def agg_tags_dedup(spark, sf_dir):
    """Distinct tags in the order in which they first came."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    tags = F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(tags, ",").alias("tags"))


# Sets


@query("SELECT doc_id AS id, lang, CAST(NULL AS BIGINT) AS turn FROM documents UNION ALL SELECT conv_id, NULL, turn FROM conversations")
def set_union_all(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn")
    return a.unionByName(b, allowMissingColumns=True)


EDGES = f"{P}, edges AS (SELECT i AS a, j AS b, s FROM p WHERE s >= 0.35)"


def edges(spark, sf_dir):
    """Pairs that match: a score of .35 or more."""
    mined = sim.pairs_where(base.labelled(spark, sf_dir), neg_from=0.35, pos_from=0.35)
    return mined.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("score").alias("s"))


@query(f"WITH {EDGES} SELECT a AS node FROM edges UNION SELECT b FROM edges")
def set_union_nodes(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select(F.col("a").alias("node")).union(e.select("b")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def set_intersect_keys(spark, sf_dir):
    d, l, e = (table(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    return d.select("doc_id").intersect(l.select("doc_id")).intersect(e.select("vec_id"))


@query("SELECT vec_id FROM embeddings EXCEPT SELECT vec_id FROM embeddings WHERE label = 3")
def set_except(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id").exceptAll(e.where("label = 3").select("vec_id"))


@query(f"WITH {EDGES}, o AS (SELECT a, b FROM edges WHERE s >= 0.36), q AS (SELECT a, b FROM edges WHERE s < 0.4) SELECT (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM q)) AS matched, (SELECT count(*) FROM o) AS first, (SELECT count(*) FROM q) AS second")
def set_matched_edges(spark, sf_dir):
    """Edges that two graphs share."""
    e = edges(spark, sf_dir)
    o, q = e.where("s >= 0.36"), e.where("s < 0.4")
    marked = o.select("a", "b", F.lit(1).alias("x")).join(q.select("a", "b", F.lit(1).alias("y")), ["a", "b"], "full_outer")
    return marked.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("matched"), F.count("x").alias("first"), F.count("y").alias("second"))


# Graphs and clusters

CC = f"{EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(node, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a)"


@query(f"WITH RECURSIVE {CC} SELECT node, min(other) AS component FROM reach GROUP BY node")
def cc_union_find(spark, sf_dir):
    return graph.components(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {CC}, g AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT vec_id, coalesce(component, vec_id) AS grp FROM embeddings LEFT JOIN g ON node = vec_id")
def cc_apply(spark, sf_dir):
    """Rows to templates to groups of templates; a template without an edge is its own group."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("node"))
    groups = graph.components(edges(spark, sf_dir), rows.select("node"))
    return rows.join(groups, "node").select("vec_id", F.col("component").alias("grp"))


def small_edges(spark, sf_dir, places=9):
    """Distances within groups of 25 rows."""
    e = base.vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 25).alias("grp"), F.col("vec_id").alias("i"), "v")
    other = e.select("grp", F.col("i").alias("j"), F.col("v").alias("w"))
    return e.join(other, "grp").where("i < j").select("grp", "i", "j", F.round(1 - dot("v", "w"), places).alias("w"))


@query()
def mst_persistence(spark, sf_dir):
    """Edges of the minimum spanning tree of each group: the pairs that die in dimension 0."""
    return graph.spanning_trees(small_edges(spark, sf_dir), "grp")


@query()
def topo_signature(spark, sf_dir):
    """The squared difference of each group's tree edges under two distances."""
    a = small_edges(spark, sf_dir)
    b = small_edges(spark, sf_dir, 2).withColumnRenamed("w", "u")
    tree = graph.spanning_trees(a, "grp")
    return tree.join(b, ["grp", "i", "j"]).groupBy("grp").agg(rounded(F.sum(F.pow(F.col("w") - F.col("u"), F.lit(2)))).alias("signature"), F.count("*").alias("edges"))


@query()
def cluster_density(spark, sf_dir):
    e = base.vectors(spark, sf_dir).select("label", F.col("vec_id").alias("id"), normalized("v").alias("v"))
    return graph.clusters(e, least=3, radius=0.25)


CENTER = f"{P}, nb AS (SELECT i AS id, j AS other, s FROM p WHERE same AND s >= 0.2 UNION ALL SELECT j, i, s FROM p WHERE same AND s >= 0.2), c AS (SELECT e.vec_id AS id, e.label8 AS label, count(other) + 1 AS n, round(coalesce(sum(s), 0) + 1, 9) AS total FROM e LEFT JOIN nb ON id = vec_id GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, total DESC, id) AS r FROM c)"


def centres(spark, sf_dir):
    rows = base.labelled(spark, sf_dir)
    counts = graph.neighbour_counts(rows, 0.2)
    best = counts.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.round("total", 9)).alias("total"), "id")).alias("b"))
    return rows, best.select("label", F.col("b.id").alias("center"), (-F.col("b.n")).alias("n"))


@query(f"WITH {CENTER} SELECT label, id AS center, n AS members FROM b WHERE r = 1")
def cluster_center(spark, sf_dir):
    """The row of each label with the most neighbours, ties by their total score."""
    return centres(spark, sf_dir)[1].select("label", "center", F.col("n").alias("members"))


@query(f"WITH {CENTER}, top AS (SELECT label, id AS center FROM b WHERE r = 1), m AS (SELECT t.label, nb.other AS vec_id FROM top t JOIN nb ON nb.id = t.center UNION SELECT label, center FROM top), x AS (SELECT m.label, d, avg(v[d]) AS x FROM m JOIN (SELECT vec_id, v, unnest(range(1, 65)) AS d FROM e) USING (vec_id) GROUP BY 1, 2), u AS (SELECT label, list(x ORDER BY d) AS c FROM x GROUP BY 1) SELECT e.label8 AS label, e.vec_id, CASE WHEN m.vec_id IS NOT NULL THEN 'member' WHEN round(list_cosine_similarity(v, c), 9) >= 0.2 THEN 'absorbed' ELSE 'noise' END AS state FROM e JOIN u ON u.label = e.label8 LEFT JOIN m ON m.vec_id = e.vec_id")
def cluster_main_absorb(spark, sf_dir):
    """Neighbours of the centre are members; others near the members' mean are absorbed."""
    rows, best = centres(spark, sf_dir)
    near = sim.pairs_where(rows, pos_from=0.2)
    ends = near.select(F.col("i").alias("center"), F.col("j").alias("vec_id")).union(near.select("j", "i"))
    members = ends.join(F.broadcast(best.select("center")), "center").select("vec_id").union(best.select("center")).distinct().withColumn("m", F.lit(True))
    marked = rows.join(members, "vec_id", "left")
    mean = pooled(marked.where("m"), ["label"], "embedding").select("label", F.col("v").alias("c"))
    score = F.round(dot("embedding", "c") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("c", "c"))), 9)
    state = F.when(F.col("m"), "member").when(score >= 0.2, "absorbed").otherwise("noise")
    return marked.join(F.broadcast(mean), "label").select("label", "vec_id", state.alias("state"))


@query()
def cluster_pipeline(spark, sf_dir):
    """Each label's clusters by density; labels without one fall back to their centre's neighbours."""
    e = base.labelled(spark, sf_dir)
    found = graph.clusters(e.select("label", F.col("vec_id").alias("id"), normalized("embedding").alias("v")), least=3, radius=0.25)
    main = found.where("cluster >= 0").groupBy("label", "cluster").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("cluster", F.struct("n", (-F.col("cluster")).alias("c"))).alias("main"))
    return found.join(main, "label", "left").select("label", "id", F.when(F.col("main").isNull(), "centre").when(F.col("cluster") == F.col("main"), "main").otherwise("noise").alias("state"))


# State and time

RING = f"{E}, b AS (SELECT vec_id, vec_id % 50 AS slot, vec_id // 50 AS lap FROM e)"


@query(f"WITH {RING} SELECT slot, max(vec_id) AS vec_id, count(*) AS writes, (SELECT least(50, count(*)) FROM e) AS valid FROM b GROUP BY slot")
def st_ring_queue(spark, sf_dir):
    """A queue of fifty slots after all rows were put in, in order: the last writer of each slot."""
    e = base.vectors(spark, sf_dir)
    last = e.groupBy((F.col("vec_id") % 50).alias("slot")).agg(F.max("vec_id").alias("vec_id"), F.count("*").alias("writes"))
    return last.join(F.broadcast(e.agg(F.least(F.lit(50).cast("long"), F.count("*")).alias("valid"))))


@query(f"WITH {RING}, q AS (SELECT slot, max(vec_id) AS vec_id FROM b GROUP BY slot), n AS (SELECT slot, e.v AS v, f.v AS old, g.v AS new FROM q JOIN e USING (vec_id) JOIN e f ON f.vec_id = slot JOIN e g ON g.vec_id = slot + 50), x AS (SELECT slot, unnest(range(1, 65)) AS d, v, old, new FROM n) SELECT slot, CAST(d AS BIGINT) AS d, {r6('v[d] + new[d] - old[d]')} AS x FROM x")
def st_queue_refresh(spark, sf_dir):
    """Queue rows moved by as much as their class's proxy has moved."""
    e = base.vectors(spark, sf_dir)
    slots = e.groupBy((F.col("vec_id") % 50).alias("slot")).agg(F.max_by("v", "vec_id").alias("v"))
    old = e.select(F.col("vec_id").alias("slot"), F.col("v").alias("old"))
    new = e.select((F.col("vec_id") - 50).alias("slot"), F.col("v").alias("new"))
    made = slots.join(old, "slot").join(new, "slot").select("slot", F.zip_with(F.zip_with("v", "new", lambda x, y: x + y), "old", lambda x, y: x - y).alias("w"))
    return made.select("slot", F.posexplode("w").alias("d", "x")).select("slot", (F.col("d") + 1).cast("long").alias("d"), rounded("x").alias("x"))


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, (round(sum(value), 4) + 0.0) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    """Tumbling windows of an hour, as a batch; the stream gives the same."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"))


@query("WITH o AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), m AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM m GROUP BY user_id, k")
def ext_sessions(spark, sf_dir):
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"))


@query("WITH x AS (SELECT epoch_us(ts) // 1000000 AS t, event_type, unnest(range(0, 4)) AS k FROM events) SELECT CAST((t // 900 - k) * 900 AS BIGINT) AS start, event_type, count(*) AS n FROM x GROUP BY 1, 2")
def ext_stream_windows(spark, sf_dir):
    """Windows of an hour every quarter of it."""
    from ..streaming.windows import sliding

    return sliding(table(spark, sf_dir, "events"))


@query(f"WITH {P}, t AS (SELECT i, j, s, row_number() OVER (ORDER BY s DESC, i, j) AS r FROM p WHERE NOT same ORDER BY s DESC, i, j LIMIT 100) SELECT i, j, s + 0.0 AS score, CAST(ceil(r / 12.0) AS BIGINT) AS page, (r - 1) % 12 // 4 AS line, (r - 1) % 4 AS place FROM t")
def sink_contact_sheet(spark, sf_dir):
    """The rows of sheets of twelve: the highest negatives with their page, line and place."""
    top = sim.extremes(base.labelled(spark, sf_dir), 100, False, True)
    placed = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "i", "j")).cast("long"))
    return placed.select("i", "j", (F.col("score") + 0.0).alias("score"), F.ceil(F.col("r") / 12).alias("page"), F.expr("(r - 1) % 12 div 4").alias("line"), ((F.col("r") - 1) % 4).alias("place"))
