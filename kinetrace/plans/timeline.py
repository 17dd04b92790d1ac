"""Queries over runs, windows, grids and masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..operators import windows as win
from ..sources.tables import HOUR, ORDER, POINTS, SAMPLES, points, samples, spans, table
from .catalog import query

KEYS = ", ".join(ORDER)
SORTED = f"PARTITION BY entity ORDER BY {KEYS}"


@query("gap_segments", f"""
WITH {POINTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS step FROM p),
s AS (SELECT *, sum(CASE WHEN step <= 0 OR step > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)
SELECT entity, segment, min(t) AS start_t, max(t) AS stop_t, count(*) AS points FROM s GROUP BY ALL""")
def gap_segments(spark, sf):
    return tl.segment_bounds(tl.with_segments(points(spark, sf), ["entity"], "t", 12 * HOUR), ["entity"], "t")


def _stats_sql(lo: int, hi: int, digits: tuple[int, int] = (6, 6)) -> str:
    low = f"{-lo} PRECEDING" if lo <= 0 else f"{lo} FOLLOWING"
    high = f"{hi - 1} FOLLOWING" if hi - 1 >= 0 else f"{1 - hi} PRECEDING"
    edge = "first_value" if hi <= 0 else "last_value"
    return f"""
WITH {SAMPLES}
SELECT entity, {KEYS}, round(coalesce(avg(x) OVER w, {edge}(x) OVER a), {digits[0]}) AS mean, round(coalesce(stddev_pop(x) OVER w, 0), {digits[1]}) AS sd
FROM s WINDOW w AS ({SORTED} ROWS BETWEEN {low} AND {high}), a AS ({SORTED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _stats(spark, sf, lo, hi):
    s = samples(spark, sf)
    mean, sd = win.mean_and_sd(F.col("x"), ["entity"], ORDER, lo, hi)
    return s.select("entity", *ORDER, F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"))


CENTERED, CAUSAL, BEFORE, AFTER = win.offsets(0.5, False), win.offsets(0.5, True), (-20, -10), (10, 20)


@query("window_stats_centered", _stats_sql(*CENTERED))
def window_stats_centered(spark, sf):
    return _stats(spark, sf, *CENTERED)


@query("window_stats_causal", _stats_sql(*CAUSAL))
def window_stats_causal(spark, sf):
    return _stats(spark, sf, *CAUSAL)


@query("window_remote_before_after", f"""
WITH {SAMPLES}
SELECT entity, {KEYS}, round(coalesce(avg(x) OVER b, first_value(x) OVER a), 6) AS before_mean, round(coalesce(avg(x) OVER f, last_value(x) OVER a), 6) AS after_mean
FROM s WINDOW b AS ({SORTED} ROWS BETWEEN 20 PRECEDING AND 11 PRECEDING), f AS ({SORTED} ROWS BETWEEN 10 FOLLOWING AND 19 FOLLOWING),
a AS ({SORTED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_remote_before_after(spark, sf):
    before, _ = win.mean_and_sd(F.col("x"), ["entity"], ORDER, *BEFORE)
    after, _ = win.mean_and_sd(F.col("x"), ["entity"], ORDER, *AFTER)
    return samples(spark, sf).select("entity", *ORDER, F.round(before, 6).alias("before_mean"), F.round(after, 6).alias("after_mean"))


@query("window_stats_wide", _stats_sql(-150, 151, (9, 5)))
def window_stats_wide(spark, sf):
    d = win.wide_mean_and_sd(samples(spark, sf), "x", ["entity"], ORDER, -150, 151, "mean", "sd")
    return d.select("entity", *ORDER, F.round("mean", 9).alias("mean"), F.round("sd", 5).alias("sd"))


@query("window_max_tail_rule", f"""
WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) - row_number() OVER ({SORTED}) AS rest, max(x) OVER ({SORTED} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS inside FROM s),
m AS (SELECT entity, max(x) AS tail FROM n WHERE rest < 25 GROUP BY entity)
SELECT entity, {KEYS}, CASE WHEN rest + 1 < 13 THEN tail ELSE inside END AS top FROM n JOIN m USING (entity)""")
def window_max_tail_rule(spark, sf):
    return win.shifted_max(samples(spark, sf), "x", ["entity"], ORDER, -12, 13, "top").select("entity", *ORDER, "top")


@query("rolling_median_baseline", f"""
WITH {SAMPLES}, b AS (SELECT *, (row_number() OVER ({SORTED}) - 1) // 5 AS block FROM s),
c AS (SELECT entity, block, x FROM b QUALIFY row_number() OVER (PARTITION BY entity, block ORDER BY {KEYS}) = 1),
m AS (SELECT entity, block, quantile_cont(x, 0.5) OVER (PARTITION BY entity ORDER BY block ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS baseline FROM c)
SELECT entity, {KEYS}, round(baseline, 6) AS baseline, round(x - baseline, 6) AS above FROM b JOIN m USING (entity, block)""")
def rolling_median_baseline(spark, sf):
    d = win.long_baseline(samples(spark, sf), "x", ["entity"], ORDER, step=5, window=30)
    return d.select("entity", *ORDER, F.round("baseline", 6).alias("baseline"), F.round(F.col("x") - F.col("baseline"), 6).alias("above"))


@query("mask_to_intervals", f"""
WITH {POINTS}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS idx FROM p),
m AS (SELECT *, idx - row_number() OVER (PARTITION BY entity ORDER BY idx) AS island FROM i WHERE score >= 0.5)
SELECT entity, min(idx) AS lo, max(idx) + 1 AS hi FROM m GROUP BY entity, island""")
def mask_to_intervals(spark, sf):
    d = points(spark, sf).withColumn("idx", F.row_number().over(tl.over(["entity"], ["t"])).cast("long"))
    return tl.mask_to_intervals(d, ["entity"], "idx", F.col("score") >= 0.5)


@query("intervals_to_mask", f"""
WITH {POINTS}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS idx FROM p)
SELECT entity, idx AS index FROM i WHERE score >= 0.5""")
def intervals_to_mask(spark, sf):
    return tl.intervals_to_mask(mask_to_intervals(spark, sf), ["entity"])


@query("run_lengths", f"""
WITH {POINTS}, c AS (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS change FROM p WINDOW w AS (PARTITION BY entity ORDER BY t)),
r AS (SELECT *, sum(change) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
SELECT entity, run, any_value(code) AS code, count(*) AS length FROM r GROUP BY entity, run""")
def run_lengths(spark, sf):
    return tl.run_lengths(points(spark, sf), ["entity"], ["t"], "code")


@query("bouts_per_day", f"""
WITH {POINTS}, e AS (SELECT *, lag(score >= 0.5) OVER (PARTITION BY entity, day ORDER BY t) AS before FROM p)
SELECT entity, day, count(*) FILTER (score >= 0.5 AND NOT coalesce(before, false)) AS bouts FROM e GROUP BY ALL""")
def bouts_per_day(spark, sf):
    d = tl.with_rising_edges(points(spark, sf), ["entity", "day"], ["t"], F.col("score") >= 0.5)
    return d.groupBy("entity", "day").agg(F.sum("bout_start").alias("bouts"))


@query("transitions_per_day", f"""
WITH {POINTS}, e AS (SELECT *, lag(score >= 0.5) OVER (PARTITION BY entity, day ORDER BY t) AS before FROM p)
SELECT entity, day, count(*) FILTER ((score >= 0.5) <> before) AS transitions FROM e GROUP BY ALL""")
def transitions_per_day(spark, sf):
    d = tl.with_rising_edges(points(spark, sf), ["entity", "day"], ["t"], F.col("score") >= 0.5)
    return d.groupBy("entity", "day").agg(F.sum("changed").alias("transitions"))


@query("boundary_dilation", f"""
WITH {POINTS}, c AS (SELECT *, coalesce((lead(score >= 0.5) OVER w) <> (score >= 0.5), false)::INT AS change FROM p WINDOW w AS (PARTITION BY entity ORDER BY t))
SELECT entity, id, max(change) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS boundary FROM c""")
def boundary_dilation(spark, sf):
    d = points(spark, sf).withColumn("state", F.col("score") >= 0.5)
    return tl.boundary_targets(d, ["entity"], ["t"], "state").select("entity", "id", "boundary")


@query("label_grid", f"""
WITH {POINTS}, b AS (SELECT entity, min(t) // 60000 AS lo, max(t) // 60000 AS hi FROM p GROUP BY entity)
SELECT entity, unnest(generate_series(lo, hi - 1, 25)) AS center FROM b WHERE hi > lo""")
def label_grid(spark, sf):
    b = points(spark, sf).groupBy("entity").agg(F.floor(F.min("t") / 60000).alias("lo"), F.floor(F.max("t") / 60000).alias("hi"))
    return tl.label_grid(b, ["entity"], "lo", "hi", 25)


@query("chunk_index", """
WITH n AS (SELECT l_suppkey AS entity, count(*) AS length FROM lineitem GROUP BY 1),
s AS (SELECT entity, length, unnest(generate_series(0, length - 1, 90)) AS start FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start) - 1 AS chunk FROM s WHERE start = 0 OR start + 10 < length)
SELECT entity, chunk, start, least(start + 100, length) AS stop FROM k WHERE least(start + 100, length) - start >= 2""")
def chunk_index(spark, sf):
    return tl.chunk_index(samples(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("length")), ["entity"], "length", 100, 10)


RESAMPLED = f"""
WITH {POINTS}, q AS (SELECT *, score * 1000 AS v FROM p), r AS (SELECT entity, t AS t1, v AS v1, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM q WINDOW w AS (PARTITION BY entity ORDER BY t)),
g AS (SELECT *, unnest(generate_series(CASE WHEN t0 IS NULL THEN (t1 + {HOUR} - 1) // {HOUR} ELSE t0 // {HOUR} + 1 END, t1 // {HOUR})) * {HOUR} AS grid_t FROM r)
"""


@query("resample_linear", RESAMPLED + "SELECT entity, grid_t, round_even(CASE WHEN t0 IS NULL OR grid_t = t1 THEN v1 ELSE v0 + (v1 - v0) * ((grid_t - t0)::DOUBLE / (t1 - t0)) END, 0) AS resampled FROM g")
def resample_linear(spark, sf):
    d = points(spark, sf).withColumn("v", F.col("score") * 1000)
    return tl.resample_linear(d, ["entity"], "t", "v", HOUR).drop("flagged")


@query("quality_flag", RESAMPLED + f"SELECT entity, grid_t, coalesce(abs(t1 - t0 - {7 * HOUR}) > {3 * HOUR}, false)::INT AS flagged FROM g")
def quality_flag(spark, sf):
    d = points(spark, sf).withColumn("v", F.col("score") * 1000)
    return tl.resample_linear(d, ["entity"], "t", "v", HOUR, jitter=3 * HOUR, nominal=7 * HOUR).drop("resampled")


@query("quality_spans", """
WITH o AS (SELECT o_custkey AS entity, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1)
SELECT entity, n, finished, round(finished / n, 6) AS share FROM o""")
def quality_spans(spark, sf):
    d = spans(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("finished"))
    return d.withColumn("share", F.round(F.col("finished") / F.col("n"), 6))


@query("first_sessions", """
WITH s AS (SELECT DISTINCT o_custkey AS entity FROM orders ORDER BY 1 LIMIT 25)
SELECT o_custkey AS entity, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT entity FROM s)""")
def first_sessions(spark, sf):
    """The first N sessions in key order, by semi join."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"))
    return o.join(o.select("entity").distinct().orderBy("entity").limit(25), "entity", "left_semi")
