"""Queries over event intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import timeline as tl
from ..sources.tables import HOUR, POINTS, SPANS, points, spans
from .catalog import query

HIGH, LOW, GAP, STEP, MERGE, LEAST = 0.7, 0.42, 12 * HOUR, HOUR, 6 * HOUR, 2 * HOUR
DAYS = 365


def _hysteresis_sql(high: float, low: float, tail: str) -> str:
    return f"""
WITH {POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM p),
r AS (SELECT *, i - row_number() OVER (PARTITION BY entity ORDER BY t) AS run FROM n WHERE score >= {low}),
k AS (SELECT * FROM r QUALIFY max(score) OVER (PARTITION BY entity, run) >= {high}),
j AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) > {GAP} THEN 1 ELSE 0 END AS b FROM k)),
raw AS (SELECT entity, min(t) AS start_t, max(t) + {STEP} AS end_t FROM j GROUP BY entity, g),
m AS (SELECT *, CASE WHEN start_t - max(end_t) OVER (PARTITION BY entity ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {MERGE} THEN 1 ELSE 0 END AS fresh FROM raw),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) AS g FROM m),
f AS (SELECT entity, min(start_t) AS start_t, max(end_t) AS end_t FROM h GROUP BY entity, g HAVING max(end_t) - min(start_t) >= {LEAST})
{tail}"""


SCORED = "SELECT entity, start_t, end_t, coalesce((SELECT round_even(max(score), 4) FROM p WHERE p.entity = f.entity AND t >= start_t AND t < end_t), 0) AS max_prob FROM f"


def _assembled(spark, sf, high, low):
    return iv.assemble_events(points(spark, sf), ["entity"], "t", "score", high, low, GAP, STEP, F.lit(MERGE), F.lit(LEAST))


@query("hysteresis_intervals", _hysteresis_sql(HIGH, LOW, SCORED))
def hysteresis_intervals(spark, sf):
    """Flagship: scores to intervals with their best score."""
    return iv.interval_scores(_assembled(spark, sf, HIGH, LOW), points(spark, sf), ["entity"], ["start_t", "end_t"], "t", "score", 24 * HOUR)


@query("single_threshold_intervals", _hysteresis_sql(HIGH, HIGH, "SELECT * FROM f"))
def single_threshold_intervals(spark, sf):
    return _assembled(spark, sf, HIGH, HIGH)


@query("positive_runs", f"""
WITH {POINTS}, b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity, code ORDER BY t) > {GAP} THEN 1 ELSE 0 END AS b FROM p WHERE score >= 0.5),
g AS (SELECT *, sum(b) OVER (PARTITION BY entity, code ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT entity, code, min(t) AS start_t, max(t) + {STEP} AS end_t FROM g GROUP BY entity, code, g""")
def positive_runs(spark, sf):
    return iv.assemble(points(spark, sf).filter("score >= 0.5"), ["entity", "code"], "t", GAP, STEP)


MERGED = f"""{SPANS}, m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 20 THEN 1 ELSE 0 END AS fresh FROM o),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)"""


@query("merge_filter_intervals", f"WITH {MERGED} SELECT entity, min(s) AS s, max(e) AS e FROM h GROUP BY entity, g HAVING max(e) - min(s) >= 30")
def merge_filter_intervals(spark, sf):
    return iv.merge_and_drop(spans(spark, sf).select("entity", "s", "e"), ["entity"], F.lit(20), F.lit(30), "s", "e")


@query("interval_max_score", f"""
WITH {POINTS}, {SPANS.replace('o AS', 'o0 AS')}, o AS (SELECT entity % 150 AS entity, id, 1704067200000 + (s % 30) * {24 * HOUR} AS start_t, 1704067200000 + (s % 30) * {24 * HOUR} + (e - s) * {HOUR} AS end_t FROM o0)
SELECT entity, id, start_t, end_t, coalesce((SELECT round_even(max(score), 4) FROM p WHERE p.entity = o.entity AND t >= start_t AND t < end_t), 0) AS max_prob FROM o""")
def interval_max_score(spark, sf):
    return iv.interval_scores(_windows(spark, sf).drop("status"), points(spark, sf), ["entity"], ["id"], "t", "score", 24 * HOUR)


def _windows(spark, sf):
    """Order intervals placed on the events' month."""
    at = F.lit(1704067200000) + (F.col("s") % 30) * 24 * HOUR
    return spans(spark, sf).select((F.col("entity") % 150).alias("entity"), "id", at.alias("start_t"), (at + (F.col("e") - F.col("s")) * HOUR).alias("end_t"), "status")


WINDOWS = f"{SPANS.replace('o AS', 'o0 AS')}, o AS (SELECT entity % 150 AS entity, id, status, 1704067200000 + (s % 30) * {24 * HOUR} AS start_t, 1704067200000 + (s % 30) * {24 * HOUR} + (e - s) * {HOUR} AS end_t FROM o0)"


@query("snap_to_boundaries", f"""
WITH {POINTS}, {WINDOWS}, b AS (SELECT * FROM p WHERE score >= 0.5),
n AS (SELECT o.*, coalesce((SELECT max_by(t, (score, -t)) FROM b WHERE b.entity = o.entity AND t BETWEEN start_t - {6 * HOUR} AND start_t + {6 * HOUR}), start_t) AS s2,
  coalesce((SELECT max_by(t, (score, -t)) FROM b WHERE b.entity = o.entity AND t BETWEEN end_t - {6 * HOUR} AND end_t + {6 * HOUR}), end_t) AS e2 FROM o)
SELECT entity, id, CASE WHEN e2 - s2 >= {4 * HOUR} THEN s2 ELSE start_t END AS start_t, CASE WHEN e2 - s2 >= {4 * HOUR} THEN e2 ELSE end_t END AS end_t FROM n""")
def snap_to_boundaries(spark, sf):
    return iv.snap(_windows(spark, sf).drop("status"), points(spark, sf), ["entity"], ["id"], "t", "score", 6 * HOUR, 0.5, 4 * HOUR, 24 * HOUR)


@query("interval_point_join", f"WITH {POINTS}, {WINDOWS} SELECT o.entity, o.id AS interval_id, p.id FROM o JOIN p ON p.entity = o.entity AND t >= start_t AND t < end_t")
def interval_point_join(spark, sf):
    w = _windows(spark, sf).withColumnRenamed("id", "interval_id")
    return iv.points_in(points(spark, sf), w, ["entity"], "t", "start_t", "end_t", 24 * HOUR).select("entity", "interval_id", "id")


@query("owning_segment", f"""
WITH {POINTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS step FROM p),
s AS (SELECT *, sum(CASE WHEN step > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g),
b AS (SELECT entity, segment, min(t) AS lo, max(t) + 1 AS hi FROM s GROUP BY ALL)
SELECT p.entity, p.id, b.segment, p.t - b.lo AS since_start FROM p JOIN b ON b.entity = p.entity AND p.t >= lo AND p.t < hi""")
def owning_segment(spark, sf):
    """Points to the segment that owns them."""
    p = points(spark, sf)
    b = tl.segment_bounds(tl.with_segments(p, ["entity"], "t", 12 * HOUR), ["entity"], "t").select("entity", "segment", F.col("start_t").alias("lo"), (F.col("stop_t") + 1).alias("hi"))
    return iv.points_in(p, b, ["entity"], "t", "lo", "hi", 24 * HOUR).select("entity", "id", "segment", (F.col("t") - F.col("lo")).alias("since_start"))


OVERLAP = f"WITH {SPANS} SELECT a.entity, a.id FROM o a WHERE a.status = 'F' AND {{0}} EXISTS (SELECT 1 FROM o b WHERE b.entity = a.entity AND b.status = 'O' AND a.s < b.e AND a.e > b.s)"


def _overlap(spark, sf):
    o = spans(spark, sf)
    b = o.filter("status = 'O'").select("entity", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return iv.with_overlap_flag(o.filter("status = 'F'"), b, ["entity"], ["id"], DAYS, ("s", "e"), ("s2", "e2"))


@query("overlap_semi", OVERLAP.format(""))
def overlap_semi(spark, sf):
    return _overlap(spark, sf).filter("overlapped").select("entity", "id")


@query("overlap_anti", OVERLAP.format("NOT"))
def overlap_anti(spark, sf):
    return _overlap(spark, sf).filter("NOT overlapped").select("entity", "id")


@query("interval_iou", f"""
WITH {SPANS} SELECT a.entity, a.id, b.id AS other, round(greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) / greatest(greatest(a.e, b.e) - least(a.s, b.s), 1), 9) AS iou
FROM o a JOIN o b ON a.entity = b.entity AND a.status = 'F' AND b.status = 'O' AND a.s < b.e AND a.e > b.s""")
def interval_iou(spark, sf):
    o = spans(spark, sf)
    b = o.filter("status = 'O'").select("entity", F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = iv.overlap_pairs(o.filter("status = 'F'"), b, ["entity"], DAYS, ("s", "e"), ("s2", "e2"))
    return pairs.select("entity", "id", "other", F.round(iv.iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 9).alias("iou"))


def truth_and_prediction(spark, sf):
    """Finished orders as truth, open ones as predictions, numbered by start per customer."""
    o, w = spans(spark, sf), tl.over(["entity"], ["s", "e", "id"])
    truth = o.filter("status = 'F'").select("entity", (F.row_number().over(w) - 1).cast("long").alias("ti"), F.col("s").alias("ts"), F.col("e").alias("te"))
    pred = o.filter("status = 'O'").select("entity", (F.row_number().over(w) - 1).cast("long").alias("pi"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    return truth, pred


NUMBERED = f"""{SPANS}, tr AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY s, e, id) - 1 AS ti, s AS ts, e AS te FROM o WHERE status = 'F'),
pr AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY s, e, id) - 1 AS pi, s AS ps, e AS pe FROM o WHERE status = 'O')"""


def matching_sql(where: str, rank: str, head: str = "WITH ", cut: str = "") -> str:
    """Greedy matching as a fold in DuckDB: the state carries the accepted pairs."""
    return f"""{head}{NUMBERED}, c AS (SELECT entity, ti, pi, ts, te, ps, pe, greatest(least(te, pe) - greatest(ts, ps), 0) / greatest(greatest(te, pe) - least(ts, ps), 1) AS iou FROM tr JOIN pr USING (entity) WHERE {where}),
l AS (SELECT entity, list([{{'t': ti, 'p': pi}}] ORDER BY {rank}) AS x FROM c {cut} GROUP BY entity),
m AS (SELECT entity, list_reduce(x, lambda a, y: CASE WHEN len(list_filter(a, lambda z: z.t = y[1].t OR z.p = y[1].p)) > 0 THEN a ELSE list_concat(a, y) END) AS matches FROM l)"""


@query("tolerance_match", matching_sql("least(te + 25, pe) - greatest(ts - 25, ps) > 0", "least(te + 25, pe) - greatest(ts - 25, ps) DESC, ti DESC, pi DESC") + " SELECT entity, unnest(matches).t AS truth, unnest(matches).p AS pred FROM m")
def tolerance_match(spark, sf):
    m = iv.tolerance_matches(*truth_and_prediction(spark, sf), ["entity"], 25, DAYS)
    return m.select("entity", F.col("t").alias("truth"), F.col("p").alias("pred"))


@query("tiou_match", matching_sql("ts < pe AND te > ps", "iou DESC, ti, pi", cut="WHERE iou >= 0.25") + " SELECT entity, unnest(matches).t AS truth, unnest(matches).p AS pred FROM m")
def tiou_match(spark, sf):
    m = iv.iou_matches(*truth_and_prediction(spark, sf), ["entity"], 0.25, DAYS)
    return m.select("entity", F.col("t").alias("truth"), F.col("p").alias("pred"))


@query("score_peaks", f"""
WITH {POINTS}, h AS (SELECT *, score >= 0.8 AS hot FROM p), l AS (SELECT *, last_value(CASE WHEN hot THEN t END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h),
n AS (SELECT *, sum(CASE WHEN hot AND (prev IS NULL OR t - prev > {24 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM l),
k AS (SELECT * FROM n WHERE g > 0 QUALIFY t <= max(CASE WHEN hot THEN t END) OVER (PARTITION BY entity, g))
SELECT entity, min(t) - {HOUR} AS start_t, max(t) + {2 * HOUR} AS end_t, max_by(t, (score, -t)) AS peak_t, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(*) AS points FROM k GROUP BY entity, g""")
def score_peaks(spark, sf):
    d = iv.peaks(points(spark, sf), ["entity"], "t", "score", F.col("score") >= 0.8, 24 * HOUR, HOUR, HOUR)
    return d.withColumn("max_score", F.round("max_score", 6)).withColumn("mean_score", F.round("mean_score", 6))
