"""Prediction of whole sessions: features, scores, event intervals and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENTS, MERGE_GAP_MS, MIN_LENGTH_MS, NAMES, STEP_MS
from ..models.boosting import Task, predict
from ..operators import intervals
from ..sources import sinks
from ..sources.scratch import written

SESSION = ["cache_key", "cow_id", "device_mac", "session_id"]
GAP_MS = 750


def dense_scores(features: DataFrame, tasks: list[Task], threshold: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(dense, thresholds): one row per decision point with all probabilities; ``features`` has SESSION, center_index,
    center_time_ms and the model's columns. Heads that no task trained are 0 (posture 0.5). ``threshold`` overrides all.
    """
    if threshold is not None and not 0 < threshold < 1:
        raise ValueError("threshold must lie in (0, 1)")
    held = {t.name: t.threshold for t in tasks}
    limits = {e: threshold if threshold is not None else held.get(e, 0.5) for e in EVENTS}
    d = predict(features, tasks)
    d = d.withColumns({f"prob_{e}": F.lit(0.0) for e in EVENTS if f"prob_{e}" not in d.columns})
    return d.select(*SESSION, "center_index", "center_time_ms", "prob_posture_UPRIGHT", "prob_posture_LYING", "prob_WALKING", *[f"prob_{e}" for e in EVENTS]), limits


def candidates(dense: DataFrame, limits: dict[str, float], events: tuple[str, ...] = EVENTS, boundary: str | None = None, postprocess: bool = True) -> DataFrame:
    """Event intervals of every session and event with their label, highest probability and threshold.

    All events are assembled in one pass over the long form; each has its own threshold, merge gap and least length.
    """
    width, by = 60_000, [*SESSION, "event_code"]
    long = dense.select(*SESSION, F.col("center_time_ms").alias("t"), F.explode(F.array(*[F.struct(F.lit(e).alias("event_code"), F.col(f"prob_{e}").alias("score"), F.lit(limits[e]).alias("high")) for e in events])).alias("x"))
    long = long.select(*SESSION, "t", "x.*").withColumn("score", F.col("score") / F.col("high"))  # in units of the threshold
    code = lambda table, none: F.element_at(F.create_map(*[F.lit(v) for e in events for v in (e, table.get(e, none))]), F.col("event_code"))
    gap, least = (code(MERGE_GAP_MS, 0), code(MIN_LENGTH_MS, 0)) if postprocess else (F.lit(-1), F.lit(0))
    edge = None if boundary is None else dense.select(*SESSION, F.col("center_time_ms").alias("t"), F.col(boundary).alias("boundary")).withColumn("event_code", F.explode(F.array(*map(F.lit, events))))
    found = intervals.assemble_events(long, by, "t", "score", 1.0, 0.6 if postprocess else 1.0, GAP_MS, STEP_MS, gap, least, edge)
    raw = long.select(*by, "t", (F.col("score") * F.col("high")).alias("score"))
    out = intervals.interval_scores(found.withColumn("place", F.col("start_t")), raw, by, ["place"], "t", "score", width)
    of_code = lambda values: F.element_at(F.create_map(*[F.lit(v) for e in events for v in (e, values[e])]), F.col("event_code"))
    seconds = ((F.col("end_t") - F.col("start_t")) / 1000.0).alias("duration_s")
    return out.select(*by, of_code({e: NAMES[e][0] for e in events}).alias("label"), "start_t", "end_t", seconds, "max_prob", of_code(limits).cast("double").alias("threshold"))


def write_run(dense: DataFrame, found: DataFrame, path: str, manifest: dict) -> None:
    """Dense scores, candidates and the run's manifest; the scores are computed once."""
    sinks.write_table(dense, f"{path}/dense")
    sinks.write_table(found, f"{path}/candidates", manifest, format="csv")


def run(features: DataFrame, tasks: list[Task], path: str | None = None, threshold: float | None = None, postprocess: bool = True, manifest: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(dense, candidates) of all sessions of a feature table, written below ``path`` if it is given."""
    dense, limits = dense_scores(features, tasks, threshold)
    dense = written(dense, "prediction-dense")
    found = candidates(dense, limits, postprocess=postprocess)
    if path is not None:
        write_run(dense, found, path, {"thresholds": limits, "postprocess": postprocess} | (manifest or {}))
    return dense, found
