"""Queries over metrics and the day layer, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily, evaluation, metrics
from ..operators import intervals as iv
from ..operators import timeline as tl
from ..sources.tables import POINTS, points, table
from .catalog import query
from .events import DAYS, matching_sql, truth_and_prediction

CLASSES = "c AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber % 4 END AS actual, CAST(l_quantity AS BIGINT) % 4 AS predicted, l_suppkey AS entity FROM lineitem)"


def classes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_linenumber") % 4).alias("actual"), (F.col("l_quantity").cast("long") % 4).alias("predicted"), F.col("l_suppkey").alias("entity"))


GRID = f"{CLASSES}, g AS (SELECT a.range AS actual, b.range AS predicted, (SELECT count(*) FROM c WHERE c.actual = a.range AND c.predicted = b.range) AS n FROM range(4) a, range(4) b)"
PER_CLASS = f"""{GRID}, k AS (SELECT x.range AS class, (SELECT sum(n) FROM g WHERE actual = x.range AND predicted = x.range) AS tp, (SELECT sum(n) FROM g WHERE actual = x.range)::BIGINT AS support, (SELECT sum(n) FROM g WHERE predicted = x.range) AS called FROM range(4) x),
pr AS (SELECT class, support, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM k),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("confusion_matrix", f"WITH {GRID} SELECT * FROM g")
def confusion_matrix(spark, sf):
    return metrics.confusion(classes(spark, sf), "actual", "predicted", 4)


@query("class_scores", f"WITH {PER_CLASS} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f")
def class_scores(spark, sf):
    s = metrics.class_scores(metrics.confusion(classes(spark, sf), "actual", "predicted", 4))
    return s.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_f1", f"WITH {PER_CLASS} SELECT (SELECT sum(n) FROM g)::BIGINT AS evaluated, round((SELECT sum(n) FROM g WHERE actual = predicted) / (SELECT sum(n) FROM g), 9) AS mof, round((SELECT avg(f1) FROM f), 9) AS macro_f1")
def macro_f1(spark, sf):
    return metrics.multiclass(classes(spark, sf), "actual", "predicted", 4).select("evaluated", F.round("mof", 9).alias("mof"), F.round("macro_f1", 9).alias("macro_f1"))


#: Events as binary heads: one code has no positives, one no negatives.
HEADS = f"{POINTS}, h AS (SELECT code, entity, round(score, 2) AS score, CASE WHEN code = 'error' THEN 0 WHEN code = 'click' THEN 1 ELSE (id % 5 = 0)::INT END AS actual FROM p)"


def heads(spark, sf):
    actual = F.when(F.col("code") == "error", 0).when(F.col("code") == "click", 1).otherwise((F.col("id") % 5 == 0).cast("int"))
    return points(spark, sf).select("code", "entity", F.round("score", 2).alias("score"), actual.alias("actual"))


CURVE = f"""{HEADS}, s AS (SELECT code, score, sum(actual)::BIGINT AS pos, count(*) AS n FROM h GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY code) AS positives, sum(n) OVER (PARTITION BY code) AS total FROM s WINDOW w AS (PARTITION BY code ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT code, CASE WHEN max(positives) > 0 AND max(positives) < max(total) THEN sum(pos / nullif(positives, 0) * tp / called) END AS ap FROM k GROUP BY code)"""


@query("average_precision", f"WITH {CURVE} SELECT code, round(ap, 9) AS average_precision FROM ap")
def average_precision(spark, sf):
    return metrics.average_precision(heads(spark, sf), ["code"], "actual", "score").select("code", F.round("average_precision", 9).alias("average_precision"))


def _threshold_sql(b2: float, bound: float | None) -> str:
    keep = "count(*) OVER () > 0" if bound is None else f"(called / total <= {bound} OR NOT bool_or(called / total <= {bound}) OVER (PARTITION BY code))"
    return f"""WITH {CURVE}, q AS (SELECT *, CASE WHEN {b2} * tp / called + tp / positives > 0 THEN {1 + b2} * (tp / called) * (tp / positives) / ({b2} * tp / called + tp / positives) ELSE 0 END AS f FROM k WHERE positives > 0 AND positives < total QUALIFY {keep}),
t AS (SELECT code, score, f FROM q QUALIFY f >= max(f) OVER (PARTITION BY code) - 1e-12)
SELECT code, coalesce(min_by(score, (abs(score - 0.5), score)), 0.5) AS threshold, round(max(f), 9) AS best_f FROM (SELECT DISTINCT code FROM h) c LEFT JOIN t USING (code) GROUP BY code"""


@query("choose_threshold", _threshold_sql(1.0, None))
def choose_threshold(spark, sf):
    return metrics.choose_threshold(heads(spark, sf), ["code"], "actual", "score").withColumn("best_f", F.round("best_f", 9))


@query("choose_threshold_bounded", _threshold_sql(0.25, 0.3))
def choose_threshold_bounded(spark, sf):
    return metrics.choose_threshold(heads(spark, sf), ["code"], "actual", "score", beta=0.5, most_positive=0.3).withColumn("best_f", F.round("best_f", 9))


def _points_sql(by: str, join: str) -> str:
    return f"""WITH {CURVE}, m AS (SELECT {by}, count(*) AS evaluated, count(*) FILTER (actual = 1) AS positive, count(*) FILTER (actual = 0) AS negative, count(*) FILTER (score >= 0.5) AS predicted_positive,
  count(*) FILTER (score >= 0.5 AND actual = 0) AS false_positive, count(*) FILTER (score >= 0.5 AND actual = 1) AS tp FROM h GROUP BY ALL)
SELECT {by}, evaluated, positive, negative, predicted_positive, false_positive,
  CASE WHEN positive > 0 AND negative > 0 THEN 'positive_and_trusted_negative' WHEN positive > 0 THEN 'positive_only_recall' ELSE 'trusted_negative_only' END AS scope,
  round(false_positive / nullif(negative, 0), 9) AS false_positive_rate, round(CASE WHEN positive > 0 AND negative > 0 THEN coalesce(tp / nullif(predicted_positive, 0), 0) END, 9) AS precision,
  round(CASE WHEN positive > 0 THEN tp / positive END, 9) AS recall, round(CASE WHEN positive > 0 AND negative > 0 THEN coalesce(2 * tp / nullif(predicted_positive + positive, 0), 0) END, 9) AS f1{join}"""


@query("binary_point_metrics", _points_sql("code", ", round(ap, 9) AS average_precision FROM m JOIN ap USING (code)"))
def binary_point_metrics(spark, sf):
    d = metrics.binary_points(heads(spark, sf), ["code"], "actual", "score", F.lit(0.5))
    return d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes])


@query("per_cow_metrics", _points_sql("entity", " FROM m"))
def per_cow_metrics(spark, sf):
    d = metrics.binary_points(heads(spark, sf), ["entity"], "actual", "score", F.lit(0.5)).drop("average_precision")
    return d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes])


@query("bootstrap_ci", f"""
WITH {POINTS}, g AS (SELECT entity, avg(score) AS v FROM p GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY entity) - 1 AS i, count(*) OVER () AS n FROM g),
d AS (SELECT a.range AS r, ('0x' || md5('20260819:' || a.range || ':' || b.range)[1:12])::BIGINT % (SELECT max(n) FROM r) AS i FROM range(1000) a, range((SELECT max(n) FROM r)) b),
m AS (SELECT d.r, avg(v) AS m FROM d JOIN r USING (i) GROUP BY 1)
SELECT round((SELECT avg(v) FROM g), 9) AS point, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, (SELECT count(*) FROM g) AS groups FROM m""")
def bootstrap_ci(spark, sf):
    g = points(spark, sf).groupBy("entity").agg(F.avg("score").alias("v"))
    return metrics.bootstrap(g, "v").select(*[F.round(c, 9).alias(c) for c in ("point", "low", "high")], "groups")


@query("bootstrap_median", f"""
WITH {POINTS}, g AS (SELECT entity, avg(score) AS v FROM p GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY entity) - 1 AS i, count(*) OVER () AS n FROM g),
d AS (SELECT a.range AS r, ('0x' || md5('20260819:' || a.range || ':' || b.range)[1:12])::BIGINT % (SELECT max(n) FROM r) AS i FROM range(1000) a, range((SELECT max(n) FROM r)) b),
m AS (SELECT d.r, quantile_cont(v, 0.5) AS m FROM d JOIN r USING (i) GROUP BY 1)
SELECT round((SELECT quantile_cont(v, 0.5) FROM g), 9) AS point, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, (SELECT count(*) FROM g) AS groups FROM m""")
def bootstrap_median(spark, sf):
    g = points(spark, sf).groupBy("entity").agg(F.avg("score").alias("v"))
    return metrics.bootstrap(g, "v", statistic="median").select(*[F.round(c, 9).alias(c) for c in ("point", "low", "high")], "groups")


@query("selection_score", f"""
WITH {CURVE}, v AS (SELECT (SELECT avg(ap) FROM ap) AS events, (SELECT ap FROM ap WHERE code = 'error') AS walking, 0.75::DOUBLE AS posture)
SELECT round((0.5 * posture + 0.3 * coalesce(walking, 0) + 0.2 * coalesce(events, 0)) / (0.5 + CASE WHEN walking IS NULL THEN 0 ELSE 0.3 END + CASE WHEN events IS NULL THEN 0 ELSE 0.2 END), 9) AS selection_score FROM v""")
def selection_score(spark, sf):
    ap = metrics.average_precision(heads(spark, sf), ["code"], "actual", "score")
    v = ap.agg(F.avg("average_precision").alias("events"), F.max(F.when(F.col("code") == "error", F.col("average_precision"))).alias("walking"))
    return v.select(F.round(metrics.selection_score(F.lit(0.75), F.col("walking"), F.col("events")), 9).alias("selection_score"))


RUNS = "(SELECT entity, day, string_agg({0}, '' ORDER BY t) FILTER (change) AS {1} FROM (SELECT *, {0} IS DISTINCT FROM lag({0}) OVER (PARTITION BY entity, day ORDER BY t) AS change FROM z) GROUP BY ALL)"


@query("edit_score", f"""
WITH {POINTS}, z AS (SELECT *, CASE WHEN score >= 0.5 THEN '1' ELSE '0' END AS a, CASE WHEN score >= 0.4 THEN '1' ELSE '0' END AS b FROM p), ra AS {RUNS.format('a', 'runs_a')}, rb AS {RUNS.format('b', 'runs_b')}
SELECT entity, day, round(CASE WHEN greatest(length(runs_a), length(runs_b)) > 0 THEN (1 - levenshtein(runs_a, runs_b) / greatest(length(runs_a), length(runs_b))) * 100 ELSE 100 END, 6) AS edit_score FROM ra JOIN rb USING (entity, day)""")
def edit_score(spark, sf):
    z = points(spark, sf).withColumn("a", (F.col("score") >= 0.5).cast("int")).withColumn("b", (F.col("score") >= 0.4).cast("int"))
    by = ["entity", "day"]
    runs = tl.run_string(z, by, ["t"], "a").withColumnRenamed("runs", "runs_a").join(tl.run_string(z, by, ["t"], "b").withColumnRenamed("runs", "runs_b"), by)
    return runs.select(*by, F.round(metrics.edit_score(runs, "runs_a", "runs_b"), 6).alias("edit_score"))


def _matched(spark, sf, least):
    truth, pred = truth_and_prediction(spark, sf)
    return truth, pred, iv.iou_matches(truth, pred, ["entity"], least, DAYS)


PAIRED = matching_sql("ts < pe AND te > ps", "iou DESC, ti, pi", cut="WHERE iou >= 0.1") + ", u AS (SELECT entity, unnest(matches).t AS ti, unnest(matches).p AS pi FROM m)"


@query("onset_error", PAIRED + " SELECT count(*) AS matched, quantile_cont(abs(ps - ts), 0.5) AS median, round(quantile_cont(abs(ps - ts), 0.9), 6) AS p90 FROM u JOIN tr USING (entity, ti) JOIN pr USING (entity, pi)")
def onset_error(spark, sf):
    truth, pred, m = _matched(spark, sf, 0.1)
    pairs = m.select("entity", F.col("t").alias("ti"), F.col("p").alias("pi")).join(truth, ["entity", "ti"]).join(pred, ["entity", "pi"])
    return metrics.localisation(pairs, [], F.col("ps") - F.col("ts")).withColumn("p90", F.round("p90", 6))


def _f1_sql(least: float) -> str:
    inner = matching_sql("ts < pe AND te > ps", "iou DESC, ti, pi", cut=f"WHERE iou >= {least}")
    return f"(SELECT {least}::DOUBLE AS tiou, *, round(2 * tp / (truth + pred), 9) AS f1 FROM ({inner} SELECT coalesce(sum(len(matches)), 0)::BIGINT AS tp, (SELECT count(*) FROM tr) AS truth, (SELECT count(*) FROM pr) AS pred FROM m))"


@query("tiou_match_f1", " UNION ALL ".join(map(_f1_sql, (0.1, 0.25, 0.5))))
def tiou_match_f1(spark, sf):
    truth, pred = truth_and_prediction(spark, sf)
    counts = truth.agg(F.count(F.lit(1)).alias("truth")).join(F.broadcast(pred.agg(F.count(F.lit(1)).alias("pred"))), F.lit(True))

    # a greedy match by falling IoU is, for a higher limit, the part of it that reaches the limit: matched once
    m = iv.iou_matches(truth, pred, ["entity"], 0.1, DAYS).select("entity", F.col("t").alias("ti"), F.col("p").alias("pi")).join(truth, ["entity", "ti"]).join(pred, ["entity", "pi"])
    reached = iv.iou(F.col("ts"), F.col("te"), F.col("ps"), F.col("pe"))
    hits = m.agg(*[F.count_if(reached >= x).alias(f"n{x}") for x in (0.1, 0.25, 0.5)]).select(F.explode(F.array(*[F.struct(F.lit(x).alias("tiou"), F.col(f"`n{x}`").alias("tp")) for x in (0.1, 0.25, 0.5)])).alias("h")).select("h.*")
    return hits.join(F.broadcast(counts), F.lit(True)).select("tiou", "tp", "truth", "pred", F.round(metrics.f1_of(F.col("tp"), F.col("truth"), F.col("pred")), 9).alias("f1"))


@query("event_level_metrics", matching_sql("least(te + 25, pe) - greatest(ts - 25, ps) > 0", "least(te + 25, pe) - greatest(ts - 25, ps) DESC, ti DESC, pi DESC") + """,
e AS (SELECT entity, coalesce(t, 0) AS truth, coalesce(q, 0) AS pred, coalesce(len(matches), 0) AS hits FROM (SELECT entity, count(*) AS t FROM tr GROUP BY 1) FULL JOIN (SELECT entity, count(*) AS q FROM pr GROUP BY 1) USING (entity) LEFT JOIN m USING (entity))
SELECT entity, truth, pred, hits, round(hits / nullif(truth, 0), 9) AS recall, round(hits / nullif(pred, 0), 9) AS precision, 'per_cow' AS level, NULL AS evidence_level FROM e
UNION ALL SELECT NULL, sum(truth)::BIGINT, sum(pred)::BIGINT, sum(hits)::BIGINT, round(sum(hits) / nullif(sum(truth), 0), 9), round(sum(hits) / nullif(sum(pred), 0), 9), 'pooled', CASE WHEN sum(truth) >= 10 AND count(*) FILTER (truth > 0) >= 3 THEN 'evaluable' ELSE 'not_evaluable' END FROM e""")
def event_level_metrics(spark, sf):
    """Per animal, then pooled with its evidence gate."""
    truth, pred = truth_and_prediction(spark, sf)
    counts = evaluation.session_counts(truth, pred, ["entity"], iv.tolerance_matches(truth, pred, ["entity"], 25, DAYS))
    rates = lambda d: d.withColumn("recall", F.round(metrics.ratio(F.col("hits"), F.col("truth")), 9)).withColumn("precision", F.round(metrics.ratio(F.col("hits"), F.col("pred")), 9))
    cows = rates(counts).withColumn("level", F.lit("per_cow")).withColumn("evidence_level", F.lit(None).cast("string"))
    pooled = rates(evaluation.pooled_counts(counts, "entity")).withColumn("level", F.lit("pooled")).withColumn("evidence_level", metrics.evidence(F.col("truth"), F.col("animals"))).withColumn("entity", F.lit(None).cast("long"))
    return cows.unionByName(pooled.drop("animals"))


BOUNDS = {"click": 1.5, "view": 2.5, "purchase": 0.1, "error": 0.01}


@query("rate_plausibility", f"""
WITH {POINTS}, b AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in BOUNDS.items())}) v(code, bound)), n AS (SELECT code, count(*) AS n, (max(t) - min(t)) / 3600000.0 AS hours FROM p GROUP BY 1)
SELECT code, n, round(hours, 6) AS hours, CASE WHEN bound IS NULL OR hours <= 0 THEN 'unknown' WHEN n / hours / bound <= 1 THEN 'plausible' WHEN n / hours / bound <= 5 THEN 'suspicious' ELSE 'implausible' END AS verdict FROM n LEFT JOIN b USING (code)""")
def rate_plausibility(spark, sf):
    b = spark.createDataFrame(list(BOUNDS.items()), "code string, bound double")
    n = points(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 3600000.0).alias("hours")).join(F.broadcast(b), "code", "left")
    return n.select("code", "n", F.round("hours", 6).alias("hours"), metrics.plausibility(F.col("n"), F.col("hours"), F.col("bound")).alias("verdict"))


DAILY = f"""{POINTS}, e AS (SELECT *, lag(score >= 0.5) OVER (PARTITION BY entity, day ORDER BY t) AS before FROM p),
d AS (SELECT entity, day, count(*) AS steps, count(*) * (0.5 / 3600) AS observed_hours, count(*) FILTER (score >= 0.5) * (0.5 / 3600) AS lying_hours, count(*) FILTER (score < 0.2) * (0.5 / 3600) AS walking_hours,
  count(*) FILTER (score < 0.5) * (0.5 / 3600) AS upright_hours, count(*) FILTER (score >= 0.5 AND NOT coalesce(before, false)) AS lying_bouts, count(*) FILTER ((score >= 0.5) <> before) AS posture_transitions,
  count(*) FILTER (code = 'click')::DOUBLE AS click_count, count(*) FILTER (code = 'error')::DOUBLE AS error_count FROM e GROUP BY ALL)"""


def daily_table(spark, sf):
    return daily.indicators(points(spark, sf), ["entity", "day"], "t", F.col("score") >= 0.5, F.col("score") < 0.2, {"click": F.col("code") == "click", "error": F.col("code") == "error"})


@query("daily_indicators", f"WITH {DAILY} SELECT entity, day, steps, lying_bouts, posture_transitions, click_count, error_count, round(observed_hours, 9) AS observed_hours, round(lying_hours, 9) AS lying_hours, round(walking_hours, 9) AS walking_hours, round(upright_hours, 9) AS upright_hours, round(walking_hours * 2.0 + posture_transitions * 0.05, 9) AS activity_index FROM d")
def daily_indicators(spark, sf):
    d = daily_table(spark, sf)
    return d.select(*[F.round(c, 9).alias(c) if c.endswith(("hours", "index")) else c for c in d.columns])


def _baseline_sql(values: str, keep: str) -> str:
    return f"""b0 AS (SELECT *, median(v) OVER (PARTITION BY entity, k) AS centre, count(*) OVER (PARTITION BY entity, k) AS days FROM ({values}) WHERE {keep}),
b AS (SELECT entity, k, any_value(days) AS days, CASE WHEN any_value(days) >= 2 THEN any_value(centre) END AS centre, CASE WHEN any_value(days) >= 2 THEN greatest(median(abs(v - centre)) * 1.4826, 0.1 * abs(any_value(centre)), 0.05) END AS spread FROM b0 GROUP BY entity, k)"""


LONG = "SELECT entity, day, 'steps' AS k, steps::DOUBLE AS v, 1.0 AS dir FROM d UNION ALL SELECT entity, day, 'lying_bouts', lying_bouts::DOUBLE, -1.0 FROM d UNION ALL SELECT entity, day, 'click_count', click_count, 2.0 FROM d"
EVENT_DAY = "date_diff('day', DATE '2024-01-10', day) > 1"
DIRECTIONS = {"steps": 1.0, "lying_bouts": -1.0, "click_count": 2.0}


@query("robust_baseline", f"WITH {DAILY}, l AS ({LONG}), {_baseline_sql('SELECT * FROM l', EVENT_DAY)} SELECT entity, days, round(centre, 6) AS centre, round(spread, 6) AS spread FROM b WHERE k = 'steps'")
def robust_baseline(spark, sf):
    b = daily.baseline(daily_table(spark, sf), ["entity"], "steps", F.col("day"), F.lit("2024-01-10").cast("date"))
    return b.select("entity", "days", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"))


DEVIATED = f"""WITH {DAILY}, l AS ({LONG}), {_baseline_sql('SELECT * FROM l', EVENT_DAY)}, z AS (SELECT l.*, greatest(least((v - centre) / spread, 10), -10) AS z FROM l LEFT JOIN b USING (entity, k)),
s AS (SELECT entity, day, max(z) FILTER (k = 'steps') AS z_steps, max(z) FILTER (k = 'lying_bouts') AS z_lying_bouts, max(z) FILTER (k = 'click_count') AS z_click_count, sum(z * dir) / sum(CASE WHEN z IS NOT NULL THEN abs(dir) END) AS estrus_score FROM z GROUP BY ALL)"""


def _deviated(spark, sf):
    return daily.deviations(daily_table(spark, sf), "entity", "day", DIRECTIONS, F.lit("2024-01-10").cast("date"))


@query("deviation_scores", DEVIATED + " SELECT entity, day, round(z_steps, 6) AS z_steps, round(z_lying_bouts, 6) AS z_lying_bouts, round(z_click_count, 6) AS z_click_count, round(estrus_score, 6) AS estrus_score FROM s")
def deviation_scores(spark, sf):
    d = _deviated(spark, sf)
    return d.select("entity", "day", *[F.round(c, 6).alias(c) for c in d.columns[2:]])


@query("alert_days", DEVIATED + " SELECT entity, day, coalesce(estrus_score >= 1.5, false) AS alert FROM s")
def alert_days(spark, sf):
    return _deviated(spark, sf).select("entity", "day", daily.alert(F.col("estrus_score"), daily.DayLimits(alert=1.5)).alias("alert"))


MIL = f"""WITH {POINTS}, r AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY entity) * 0.05, 0)) AS k, row_number() OVER (PARTITION BY entity ORDER BY score DESC) AS r FROM p),
m AS (SELECT entity, avg(score) FILTER (r <= k) AS top_k_mean, 1 - exp(sum(ln(1 - least(greatest(score, 1e-9), 1 - 1e-9)))) AS noisy_or, count(*) FILTER (score >= 0.5) AS fired_windows, count(*) AS windows FROM r GROUP BY entity)"""


@query("mil_day_score", MIL + " SELECT entity, round(top_k_mean, 9) AS top_k_mean, round(noisy_or, 9) AS noisy_or, fired_windows, windows, fired_windows >= 3 AND top_k_mean >= 0.5 AS alert FROM m")
def mil_day_score(spark, sf):
    d = daily.window_scores(points(spark, sf), ["entity"], "score")
    return d.select("entity", F.round("top_k_mean", 9).alias("top_k_mean"), F.round("noisy_or", 9).alias("noisy_or"), "fired_windows", "windows", "alert")


@query("day_level_metrics", DEVIATED + """, a AS (SELECT entity, coalesce(estrus_score >= 0.5, false) AS a, day_of(day) % 3 = 0 AS t, (entity % 24)::DOUBLE AS l FROM s), w AS (SELECT entity, count(*) FILTER (a AND NOT t) / count(*) * 7.0 AS w FROM a GROUP BY 1)
SELECT count(*) AS cow_days, count(*) FILTER (t AND a) AS tp, count(*) FILTER (a AND NOT t) AS fp, count(*) FILTER (t AND NOT a) AS fn, count(*) FILTER (NOT t AND NOT a) AS tn, quantile_cont(l, 0.5) FILTER (t AND a) AS lead_median, quantile_cont(l, 0.25) FILTER (t AND a) AS lead_q25, quantile_cont(l, 0.75) FILTER (t AND a) AS lead_q75,
round(count(*) FILTER (t AND a) / nullif(count(*) FILTER (t), 0), 9) AS sensitivity, round(count(*) FILTER (NOT t AND NOT a) / nullif(count(*) FILTER (NOT t), 0), 9) AS specificity, round(count(*) FILTER (t AND a) / nullif(count(*) FILTER (a), 0), 9) AS ppv, round((SELECT avg(w) FROM w), 9) AS false_alarms_per_cow_per_week FROM a""".replace("day_of(day)", "day(day)"))
def day_level_metrics(spark, sf):
    d = _deviated(spark, sf)
    out = metrics.day_level(d, F.dayofmonth("day") % 3 == 0, daily.alert(F.col("estrus_score"), daily.DayLimits(alert=0.5)), (F.col("entity") % 24).cast("double"), "entity")
    return out.select(*[F.round(c, 9).alias(c) if c in ("sensitivity", "specificity", "ppv", "false_alarms_per_cow_per_week") else c for c in out.columns])


@query("return_to_service", DEVIATED + """, a AS (SELECT entity, day, coalesce(estrus_score >= 1.0, false) AS a, abs(date_diff('day', DATE '2024-01-02' + (entity % 5)::INT, day) - 21) <= 4 AS w FROM s),
v AS (SELECT entity, count(*) FILTER (w) AS days_observed, coalesce(bool_or(a) FILTER (w), false) AS returned FROM a GROUP BY 1)
SELECT *, CASE WHEN days_observed = 0 THEN 'not_observed' WHEN returned THEN 'open_suspected' ELSE 'pregnancy_suspected' END AS verdict FROM v""")
def return_to_service(spark, sf):
    bred = F.date_add(F.lit("2024-01-02").cast("date"), (F.col("entity") % 5).cast("int"))
    return daily.return_to_service(_deviated(spark, sf), "entity", F.col("day"), daily.alert(F.col("estrus_score"), daily.DayLimits(alert=1.0)), bred)
