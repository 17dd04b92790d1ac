"""The session cache run (M05, S11, A08): raw recordings to a labelled 50 Hz cache, as one plan over all sessions.

A session that fails leaves a row in the failures and touches no other (Q8).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENTS, STEP_MS
from ..operators import labels, timeline
from ..sources import recordings, sinks
from ..sources.scratch import written

KEY = "cache_key"
GRID = STEP_MS // 20


@dataclass
class CacheRun:
    """Tables of one run: the 50 Hz signal, its segments, 2 Hz labels (all and supervised), sessions, failures, summary."""

    signal: DataFrame
    segments: DataFrame
    dense: DataFrame
    samples: DataFrame
    sessions: DataFrame
    failures: DataFrame
    summary: DataFrame

    def write(self, path: str) -> None:
        """Every table below ``path``; refuses to overwrite. The signal is partitioned by animal."""
        recordings.write_cache(self.signal, f"{path}/signal")
        for name in ("segments", "dense"):
            sinks.write_table(getattr(self, name), f"{path}/{name}")
        for name in ("samples", "sessions", "failures"):
            sinks.write_table(getattr(self, name), f"{path}/{name}", format="csv")
        sinks.write_json(self.summary.sparkSession, self.summary.first().asDict(), f"{path}/summary")


def build_cache(raw: DataFrame, annotations: DataFrame, calibration: DataFrame, coverage: DataFrame | None = None, tail: str = "derive", width: int = 60_000) -> CacheRun:
    """``raw`` has cache_key, payload, error; ``annotations`` cache_key, cow_id, device_mac, code, start_t, end_t (ms);
    ``calibration`` cache_key, eligible; ``coverage`` cache_key, event_code, exhaustive_reviewed, start_t, end_t.

    Sessions are those of the annotations. Without a manifest row, without exactly one animal and one device, without a
    credible payload or a run of 256 frames, or with two states on one point, a session fails; one whose sensor is not
    eligible is left out. Without coverage, points with a known state are supervised by proxy.
    """
    about = annotations.groupBy(KEY).agg(F.min("cow_id").alias("cow_id"), F.countDistinct("cow_id").alias("cows"), F.min("device_mac").alias("device_mac"), F.countDistinct("device_mac").alias("devices"))
    about = about.join(calibration.select(KEY, F.coalesce("eligible", F.lit(True)).alias("eligible")), KEY, "left").join(raw.select(KEY, F.col("error").alias("read_error"), F.lit(True).alias("has_raw")), KEY, "left")
    known = F.when(F.col("eligible").isNull(), "missing calibration").when(~F.col("eligible"), "").when((F.col("cows") != 1) | (F.col("devices") != 1), "not one animal and one device").when(F.col("has_raw").isNull(), "missing recording").otherwise(F.coalesce("read_error", F.lit("")))
    about = written(about.withColumn("early", known), "cache-about")
    usable = about.filter("eligible AND early = ''").select(KEY, "cow_id", "device_mac")
    frames, notes = recordings.decode_frames(raw.join(usable.select(KEY), KEY, "left_semi"), KEY, once=True)
    signal, segments = timeline.resample_session(frames, [KEY], "place", "elapsed_ms", list(recordings.RAW_CHANNELS))
    grid = timeline.label_grid(segments, [KEY, "segment_id", "start_index", "start_ms"], "start_index", "stop_index", GRID)
    points = grid.select(KEY, "segment_id", F.col("center").alias("center_index"), (F.col("start_ms") + 20 * (F.col("center") - F.col("start_index"))).alias("center_time_ms"))
    dense = labels.label_points(points.join(usable, KEY), annotations.select(KEY, "code", "start_t", "end_t"), [KEY], "center_time_ms", width, strict=False)
    dense = labels.proxy_masks(dense) if coverage is None else labels.positives_supervised(labels.review_masks(dense, coverage, [KEY], "center_time_ms", width))
    event, mask = labels.tail_policy(F.col("event_TAIL_RAISED"), F.col("mask_TAIL_RAISED"), F.greatest("event_URINATION", "event_DEFECATION"), tail)
    dense = written(dense.withColumns({"event_TAIL_RAISED": event, "mask_TAIL_RAISED": mask}), "cache-dense")
    found = dense.groupBy(KEY).agg(F.count(F.lit(1)).alias("points"), F.max("state_conflict").alias("conflict"))
    sessions = about.join(notes.select(KEY, F.col("error").alias("decode_error"), "frames", "score"), KEY, "left").join(found, KEY, "left")
    error = F.when(F.col("early") != "", F.col("early")).when(F.col("eligible"), F.coalesce("decode_error", F.when(F.col("points").isNull(), "no run of 256 frames"), F.when(F.col("conflict"), "two states on one point")))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("eligible"), "included").otherwise("excluded_sensor_qc")
    sessions = written(sessions.withColumn("error", error).withColumn("status", status).select(KEY, "cow_id", "device_mac", "status", "error", "frames", "score", "points"), "cache-sessions")
    good = sessions.filter("status = 'included'").select(KEY)
    dense = dense.drop("state_conflict").join(good, KEY, "left_semi")
    samples = sinks.sample_ids(labels.supervised(dense), [KEY], ["center_index"])
    counted = samples.agg(F.count(F.lit(1)).alias("supervised_points"), *[F.coalesce(F.sum(f"event_{e}"), F.lit(0)).alias(f"positive_{e}") for e in EVENTS], *[F.round(F.coalesce(F.sum(f"mask_{e}"), F.lit(0)) * STEP_MS / 3_600_000, 3).alias(f"hours_{e}") for e in EVENTS])
    of = lambda s: F.count_if(F.col("status") == s)
    summary = sessions.agg(F.count(F.lit(1)).alias("annotation_sessions"), of("included").alias("included_sessions"), of("excluded_sensor_qc").alias("excluded_sensor_qc_sessions"), of("failed").alias("failures"), F.coalesce(F.sum(F.when(F.col("status") == "included", F.col("points"))), F.lit(0)).alias("dense_points"))
    policy = "reviewed ranges only" if coverage is not None else "proxy: no coverage, so no false-alarm rate may be quoted"
    summary = summary.join(F.broadcast(counted), F.lit(True)).withColumn("tail_raised_policy", F.lit(tail)).withColumn("negative_policy", F.lit(policy))  # two rows of counts
    return CacheRun(signal.join(usable, KEY).join(good, KEY, "left_semi"), segments.join(good, KEY, "left_semi"), dense, samples, sessions, sessions.filter("status = 'failed'").select(KEY, "device_mac", "error"), summary)

