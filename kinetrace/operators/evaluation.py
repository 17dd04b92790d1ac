"""Event reports of one code: sessions, animals and the pool (A24, A25), from scores or from ready intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, metrics, timeline

STEP_MS, GAP_MS, TIOUS = 500, 750, (0.10, 0.25, 0.50)


def session_counts(truth: DataFrame, pred: DataFrame, by: list[str], matches: DataFrame) -> DataFrame:
    """(by, truth, pred, hits) of every group that has either."""
    count = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    c = count(truth, "truth").join(count(pred, "pred"), by, "full").join(count(matches, "hits"), by, "left")
    return c.select(*by, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("truth", "pred", "hits")])


def pooled_counts(counts: DataFrame, cow: str) -> DataFrame:
    """truth, pred, hits over all groups, and the animals that have truth."""
    return counts.agg(*[F.sum(k).alias(k) for k in ("truth", "pred", "hits")], F.countDistinct(F.when(F.col("truth") > 0, F.col(cow))).alias("animals"))


def session_report(points: DataFrame, target: str, mask: str, score: str, threshold: float, merge_gap: int, least: int, session: tuple[str, ...] = ("device_mac", "session_id"), cow: str = "cow_id", time: str = "center_time_ms", annotations: DataFrame | None = None, tolerance: int = 2500) -> tuple[DataFrame, DataFrame]:
    """(sessions, pairs) of one event: counts per session, and its matches at the lowest IoU with both intervals.

    Only points under the mask count, and only sessions that have some. Truth is the annotations' intervals (session,
    start_t, end_t) or, without any, the runs of target points. ``merge_gap`` and ``least`` may be columns of the session.
    """
    by = [*session, cow]
    d = points.filter(F.col(mask) == 1).select(*by, F.col(time).alias("t"), (F.col(target) == 1).cast("int").alias("actual"), (F.col(score) >= threshold).cast("int").alias("called"))
    base = d.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("actual") == 0).alias("negatives"))
    numbered = lambda x, s, e, i: x.select(*by, F.col("start_t").alias(s), F.col("end_t").alias(e), F.row_number().over(Window.partitionBy(*by).orderBy("start_t", "end_t")).cast("long").alias(i))
    runs = lambda c: intervals.assemble(d.filter(F.col(c) == 1), by, "t", GAP_MS, STEP_MS)
    known = runs("actual") if annotations is None else annotations.select(*session, "start_t", "end_t").join(base.select(*by), list(session))
    truth = numbered(known, "ts", "te", "ti")
    pred = numbered(intervals.merge_and_drop(runs("called"), by, F.lit(merge_gap), F.lit(least)), "ps", "pe", "pi")
    close = intervals.tolerance_matches(truth, pred, by, tolerance, 60_000)
    pairs = intervals.iou_matches(truth, pred, by, min(TIOUS), 60_000).select(*by, F.col("t").alias("ti"), F.col("p").alias("pi")).join(truth, [*by, "ti"]).join(pred, [*by, "pi"])
    reached = intervals.iou(F.col("ts"), F.col("te"), F.col("ps"), F.col("pe"))
    overlap = pairs.groupBy(*by).agg(*[F.count_if(reached >= x).alias(f"hits_{round(x * 100)}") for x in TIOUS])
    strings = timeline.run_string(d, by, ["t"], "actual").withColumnRenamed("runs", "_a").join(timeline.run_string(d, by, ["t"], "called").withColumnRenamed("runs", "_b"), by)
    edits = strings.select(*by, metrics.edit_score(strings, "_a", "_b").alias("edit_score"))
    counts = ["truth", "pred", "hits", *[f"hits_{round(x * 100)}" for x in TIOUS]]
    s = base.join(session_counts(truth, pred, by, close), by, "left").join(overlap, by, "left").join(edits, by).fillna(0, counts)
    return s.withColumn("hours", F.col("points") * STEP_MS / 3_600_000.0), pairs


def event_report(points: DataFrame, target: str, mask: str, score: str, threshold: float, merge_gap: int, least: int, session: tuple[str, ...] = ("device_mac", "session_id"), cow: str = "cow_id", time: str = "center_time_ms", annotations: DataFrame | None = None, tolerance: int = 2500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, cows, pooled) of one event.

    Sessions are those of ``session_report``. Precision, F1 and false alarms need trusted negatives;
    they may be claimed (``reportable``) with ten events of three animals. The pool's onset errors are those of the
    matches at the lowest IoU; its edit score is the mean over sessions.
    """
    s, pairs = session_report(points, target, mask, score, threshold, merge_gap, least, session, cow, time, annotations, tolerance)
    counts = ["truth", "pred", "hits", *[f"hits_{round(x * 100)}" for x in TIOUS]]
    sums = [F.sum(c).alias(c) for c in ("points", "negatives", "hours", *counts)]
    cows = rates(s.groupBy(cow).agg(*sums), F.lit(True)).withColumn("false_alarms_per_24h", metrics.ratio(F.col("pred") - F.col("hits"), F.col("hours")) * 24)
    pooled = s.agg(*sums, F.countDistinct(F.when(F.col("truth") > 0, F.col(cow))).alias("animals"), F.avg("edit_score").alias("edit_score"))
    both = (F.col("truth") > 0) & (F.col("negatives") > 0)
    pooled = rates(pooled, both).withColumn("scope", F.when(both, "positive_and_trusted_negative").when(F.col("truth") > 0, "positive_only_recall").when(F.col("negatives") > 0, "trusted_negative_only").otherwise("no_evaluable_events"))
    pooled = pooled.withColumn("false_alarms_per_hour", F.when((F.col("truth") == 0) | both, metrics.ratio(F.col("pred") - F.col("hits"), F.col("hours"))))
    pooled = pooled.withColumn("evidence_level", F.when(both & (metrics.evidence(F.col("truth"), F.col("animals")) == "evaluable"), "reportable").otherwise("not_evaluable"))
    pooled = pooled.withColumns({f"f1_at_{round(x * 100)}": metrics.f1_of(F.col(f"hits_{round(x * 100)}"), F.col("truth"), F.col("pred")) for x in TIOUS})
    onset = metrics.localisation(pairs, [], F.col("ps") - F.col("ts")).select("matched", F.col("median").alias("onset_median"), F.col("p90").alias("onset_p90"))
    return s, cows, pooled.join(F.broadcast(onset), F.lit(True))  # one row each


def rates(d: DataFrame, both: Column) -> DataFrame:
    some = F.col("truth") > 0
    d = d.withColumn("recall", F.when(some, metrics.ratio(F.col("hits"), F.col("truth"))))
    d = d.withColumn("precision", F.when(both & some, metrics.or_zero(metrics.ratio(F.col("hits"), F.col("pred")))))
    return d.withColumn("f1", F.when(both & some, metrics.f1_of(F.col("hits"), F.col("truth"), F.col("pred"))))
