"""Queries over whole runs: session cache, its failures and summary, quality flags, session checks, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..drivers import cache, prediction
from ..models.boosting import POSTURE
from ..operators import reports, splits, timeline
from ..sources import recordings
from ..sources.scratch import written
from ..sources.tables import SAMPLES, samples, table
from ..streaming import causal
from .catalog import query
from .corpus import FOLDS, folds
from .learning import replay

#: Frames of a supplier stand 20 ms apart, with a pause of a second after every 300: each whole block is a run.
BLOCK = 300
FRAMES = f"{SAMPLES}, i AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY k0, k1, k2, k3, y) - 1 AS i, CAST(x AS BIGINT) AS x, k2 FROM s), f AS (SELECT entity, i, i * 20 + (i // {BLOCK}) * 1000 + 5 AS ms, x, k2, i // {BLOCK} AS run FROM i)"


def frames(spark, sf):
    from ..operators.timeline import over

    s = samples(spark, sf).withColumn("i", F.row_number().over(over(["entity"], ["k0", "k1", "k2", "k3", "y"])) - 1)
    return s.select("entity", F.col("i").cast("long").alias("i"), (F.col("i") * 20 + F.floor(F.col("i") / BLOCK) * 1000 + 5).cast("long").alias("ms"), F.col("x").cast("long").alias("x"), F.col("k2").cast("long").alias("k2"))


RESAMPLED = f"""{FRAMES}, n AS (SELECT *, lead(ms) OVER w AS ms1, lead(x) OVER w AS x1, lead(k2) OVER w AS k21, count(*) OVER (PARTITION BY entity, run) AS n, min(ms) OVER (PARTITION BY entity, run) AS lo, max(ms) OVER (PARTITION BY entity, run) AS hi FROM f WINDOW w AS (PARTITION BY entity, run ORDER BY ms)),
k AS (SELECT * FROM n WHERE n >= 256 AND floor(hi / 20) * 20 - ceil(lo / 20) * 20 >= 255 * 20),
g AS (SELECT entity, run, (ms // 20 + 1) * 20 AS t_ms, round_even(x + (x1 - x) * (((ms // 20 + 1) * 20 - ms) / (ms1 - ms)), 0) AS x, round_even(k2 + (k21 - k2) * (((ms // 20 + 1) * 20 - ms) / (ms1 - ms)), 0) AS k2 FROM k WHERE ms1 IS NOT NULL),
r AS (SELECT entity, dense_rank() OVER (PARTITION BY entity ORDER BY run) - 1 AS segment_id, row_number() OVER (PARTITION BY entity ORDER BY t_ms) - 1 AS frame_index, t_ms, x, k2, 0 AS quality FROM g)"""


@query("resample_session", f"WITH {RESAMPLED} SELECT entity, segment_id, frame_index, t_ms, x, k2, quality FROM r")
def resample_session(spark, sf):
    """Runs of 256 frames on the common grid, numbered densely."""
    signal, _ = timeline.resample_session(frames(spark, sf), ["entity"], "i", "ms", ["x", "k2"])
    return signal


def run(spark, sf):
    """A cache run over suppliers: some recordings are cut short, some sensors excluded, some without a manifest row or with two states at once."""
    f = frames(spark, sf)
    n = F.col("x")
    frame = recordings.packed(F.col("ms"), [n, -n, n * 100, n * 7 - 200, F.col("k2"), -F.col("k2"), n - n, n - n, n - n])
    body = f.select("entity", F.struct("i", frame.alias("f")).alias("s")).groupBy("entity").agg(F.array_sort(F.collect_list("s")).alias("s"))
    payload = recordings.joined(F.col("s.f"))
    kind, key = F.col("entity") % 10, F.concat(F.lit("s"), F.col("entity")).alias("cache_key")
    raw = written(body.select(key, F.when(kind == 3, F.substring(payload, 1, 100)).otherwise(payload).alias("payload"), F.lit(None).cast("string").alias("error")), "cache-recordings")
    marks = spark.createDataFrame([(0, "STANDING", 0, 3000), (0, "LYING", 3000, 6000), (0, "URINATION", 1000, 2500), (0, "TAIL_RAISED", 500, 1200), (1, "WALKING", 2000, 4000)], "which int, code string, start_t long, end_t long")
    who = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity")).distinct()
    annotations = who.join(F.broadcast(marks), (F.col("which") == 0) | (kind == 6)).select(key, F.concat(F.lit("cow"), F.col("entity")).alias("cow_id"), F.when((kind == 7) & (F.col("code") == "LYING"), "other").otherwise("device").alias("device_mac"), "code", "start_t", "end_t")  # five rows of marks
    calibration = who.filter(kind != 4).select(key, F.when(kind == 5, False).alias("eligible"))
    return cache.build_cache(raw, annotations, calibration)


OUTCOME = f"""{RESAMPLED}, w AS (SELECT DISTINCT l_suppkey AS entity FROM lineitem), m AS (SELECT entity, entity % 10 AS kind, (SELECT count(*) FROM k WHERE k.entity = w.entity) > 0 AS has FROM w),
o AS (SELECT entity, kind, CASE WHEN kind = 4 THEN 'missing calibration' WHEN kind = 5 THEN NULL WHEN kind = 7 THEN 'not one animal and one device' WHEN kind = 3 THEN 'payload too short' WHEN NOT has THEN 'no run of 256 frames' WHEN kind = 6 THEN 'two states on one point' END AS error FROM m),
d AS (SELECT r.entity, segment_id, frame_index, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY entity, segment_id ORDER BY t_ms) - 1 AS p FROM r) r JOIN o USING (entity) WHERE p % 25 = 0 AND error IS NULL AND kind <> 5),
e AS (SELECT *, CASE WHEN t_ms < 3000 THEN 0 WHEN t_ms < 6000 THEN 1 ELSE -1 END AS body, (t_ms >= 1000 AND t_ms < 2500)::INT AS uri, greatest((t_ms >= 500 AND t_ms < 1200)::INT, (t_ms >= 1000 AND t_ms < 2500)::INT) AS tail FROM d)"""


@query("cache_sessions", f"WITH {OUTCOME} SELECT 's' || entity AS cache_key, CASE WHEN error IS NOT NULL THEN 'failed' WHEN kind = 5 THEN 'excluded_sensor_qc' ELSE 'included' END AS status, error FROM o")
def cache_sessions(spark, sf):
    """Every session's outcome; one that fails stops no other."""
    return run(spark, sf).sessions.select("cache_key", "status", "error")


@query("cache_labels", f"WITH {OUTCOME} SELECT 's' || entity AS cache_key, segment_id, frame_index AS center_index, t_ms AS center_time_ms, body AS body_target, uri AS event_urination, tail AS event_tail_raised, greatest((body >= 0)::INT, uri) AS mask_urination FROM e")
def cache_labels(spark, sf):
    """2 Hz labels of the sessions that passed."""
    return run(spark, sf).dense.select("cache_key", "segment_id", "center_index", "center_time_ms", "body_target", F.col("event_URINATION").alias("event_urination"), F.col("event_TAIL_RAISED").alias("event_tail_raised"), F.col("mask_URINATION").alias("mask_urination"))


@query("cache_summary", f"WITH {OUTCOME}, u AS (SELECT * FROM e WHERE body >= 0 OR uri > 0 OR tail > 0) SELECT (SELECT count(*) FROM o) AS annotation_sessions, (SELECT count(*) FROM o WHERE error IS NULL AND kind <> 5) AS included_sessions, (SELECT count(*) FROM o WHERE kind = 5) AS excluded_sensor_qc_sessions, (SELECT count(*) FROM o WHERE error IS NOT NULL) AS failures, (SELECT count(*) FROM e) AS dense_points, (SELECT count(*) FROM u) AS supervised_points, (SELECT coalesce(sum(uri), 0) FROM u)::BIGINT AS positive_urination, (SELECT coalesce(sum(tail), 0) FROM u)::BIGINT AS positive_tail_raised, (SELECT round(coalesce(sum(greatest((body >= 0)::INT, uri)), 0) * 500 / 3600000, 3) FROM u) AS hours_urination")
def cache_summary(spark, sf):
    """Counters of the run."""
    return run(spark, sf).summary.select("annotation_sessions", "included_sessions", "excluded_sensor_qc_sessions", "failures", "dense_points", "supervised_points", F.col("positive_URINATION").alias("positive_urination"), F.col("positive_TAIL_RAISED").alias("positive_tail_raised"), F.col("hours_URINATION").alias("hours_urination"))


@query("cache_signal", f"WITH {OUTCOME} SELECT 's' || entity AS cache_key, segment_id, frame_index, t_ms, x AS acc_x, -x AS acc_y, k2 AS gyro_y, quality FROM r JOIN o USING (entity) WHERE error IS NULL AND kind <> 5")
def cache_signal(spark, sf):
    """The 50 Hz counts of the sessions that passed."""
    return run(spark, sf).signal.select("cache_key", "segment_id", "frame_index", "t_ms", "acc_x", "acc_y", "gyro_y", "quality")


@query("quality_flags", f"WITH {FRAMES} SELECT entity, i, max((i >= entity * 3 AND i < entity * 3 + 40 OR i >= 100 AND i < 120)::INT) AS quality FROM f GROUP BY ALL")
def quality_flags(spark, sf):
    """Sparse index intervals as a 0/1 flag on frames."""
    f = frames(spark, sf).select("entity", "i")
    low = F.col("entity") * 3
    flagged = f.select("entity").distinct().select("entity", F.explode(F.array(F.struct(low.cast("long").alias("lo"), (low + 40).cast("long").alias("hi")), F.struct(F.lit(100).cast("long").alias("lo"), F.lit(120).cast("long").alias("hi")))).alias("x")).select("entity", "x.*")
    return recordings.with_quality(f, flagged, "entity", "i")


@query("unmatched_sessions", "SELECT coalesce(o_custkey, c_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) b ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_custkey IS NULL")
def unmatched_sessions(spark, sf):
    """Keys of one listing without the other."""
    a = table(spark, sf, "orders").filter("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("k"))
    return reports.unmatched(a, table(spark, sf, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("stream_daily_counts", "WITH d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, count(*) AS steps, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL) SELECT d.* FROM d WHERE day + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_daily_counts(spark, sf):
    """Tumbling days that the watermark has closed (A09 as a stream)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return replay(spark, e, "daily", lambda s: causal.daily_counts(s, ["entity"], "ts", "1 hour", clicks=F.col("event_type") == "click"), ["entity"], "ts")


@query("predicted_intervals", """
WITH t AS (SELECT user_id AS entity, epoch_us(ts) // 1000 AS t, value / (value + 35.0) AS score FROM events), g0 AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY t) * 500 AS t, score FROM t), g AS (SELECT entity, t, score / 0.5 AS s FROM g0),
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS n FROM g), l AS (SELECT *, n - row_number() OVER (PARTITION BY entity ORDER BY t) AS run FROM n WHERE s >= 0.6), h AS (SELECT * FROM l QUALIFY max(s) OVER (PARTITION BY entity, run) >= 1),
i AS (SELECT entity, min(t) AS s, max(t) + 500 AS e, max(s) * 0.5 AS m FROM h GROUP BY entity, run), z AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY entity ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 5000 THEN 1 ELSE 0 END AS new FROM i),
y AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY s ROWS UNBOUNDED PRECEDING) AS grp FROM z), o AS (SELECT entity, min(s) AS start_t, max(e) AS end_t, max(m) AS m FROM y GROUP BY entity, grp)
SELECT 'c' || entity AS cache_key, 'URINATION' AS event_code, start_t, end_t, (end_t - start_t) / 1000.0 AS duration_s, round_even(m, 4) AS max_prob FROM o WHERE end_t - start_t >= 4000""")
def predicted_intervals(spark, sf):
    """Scores at 2 Hz to event intervals with the code's own gap and length."""
    from ..functions.vocabulary import EVENTS
    from ..operators.timeline import over
    from ..sources.tables import points

    p = points(spark, sf).withColumn("n", F.row_number().over(over(["entity"], ["t"])))
    dense = p.select(F.concat(F.lit("c"), F.col("entity")).alias("cache_key"), F.col("entity").alias("cow_id"), F.lit("d").alias("device_mac"), F.lit("s").alias("session_id"), (F.col("n") * 500).cast("long").alias("center_time_ms"), F.col("score").alias("prob_URINATION"))
    found = prediction.candidates(dense, dict.fromkeys(EVENTS, 0.5), ("URINATION",))
    return found.select("cache_key", "event_code", "start_t", "end_t", "duration_s", "max_prob")


class Ratio:
    """A task whose score is an expression, so that SQL can tell what a prediction must give."""

    def __init__(self, name, score, threshold):
        self.name, self.column, self.threshold = name, score, threshold

    def score(self, d):
        return d.withColumn(f"prob_{self.name}", self.column)


@query("predicted_scores", """
WITH d AS (SELECT l_suppkey, l_orderkey, l_quantity / 50.0 AS lying, l_discount * 10 AS urination FROM lineitem)
SELECT 's' || l_suppkey AS cache_key, l_orderkey AS center_index, round(lying, 9) AS lying, round(1 - lying, 9) AS upright, 0.0::DOUBLE AS walking, round(urination, 9) AS urination, 0.0::DOUBLE AS mounting, urination >= 0.4 AS urinates, lying >= 0.5 AS lies FROM d""")
def predicted_scores(spark, sf):
    """Dense scores of a posture and an event task: the posture head is the task's, the others have their defaults."""
    d = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("cache_key"), F.col("l_suppkey").alias("cow_id"), F.lit("d").alias("device_mac"), F.lit("s").alias("session_id"), F.col("l_orderkey").alias("center_index"), F.lit(0).alias("center_time_ms"), "l_quantity", "l_discount")
    tasks = [Ratio(POSTURE, F.col("l_quantity") / 50.0, 0.5), Ratio("URINATION", F.col("l_discount") * 10, 0.4)]
    dense, limits = prediction.dense_scores(d, tasks)
    r = lambda c: F.round(f"prob_{c}", 9)
    return dense.select("cache_key", "center_index", r(POSTURE).alias("lying"), r("posture_UPRIGHT").alias("upright"), r("WALKING").alias("walking"), r("URINATION").alias("urination"), r("MOUNTING").alias("mounting"), (F.col("prob_URINATION") >= limits["URINATION"]).alias("urinates"), (F.col(f"prob_{POSTURE}") >= tasks[0].threshold).alias("lies"))


@query("stream_sliding_mean", "WITH p AS (SELECT user_id AS entity, epoch_us(ts) // 1000 AS t, value / (value + 35.0) AS score FROM events) SELECT entity, t, round(avg(score) OVER w, 9) AS mean, count(*) OVER w AS points FROM p WINDOW w AS (PARTITION BY entity ORDER BY t ROWS 3 PRECEDING)")
def stream_sliding_mean(spark, sf):
    """Trailing window of four rows, kept per animal between micro-batches (2.10)."""
    from ..sources.tables import points

    p = points(spark, sf).select("entity", "t", "score")
    d = replay(spark, p, "sliding", lambda s: causal.sliding_mean(s, "entity", "t", "score", 4), ["entity"], "t")
    return d.select("entity", "t", F.round("mean", 9).alias("mean"), "points")


@query("fold_rows", f"WITH {FOLDS} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_suppkey IN (SELECT cow FROM r WHERE fold = 2 AND role = 'train')")
def fold_rows(spark, sf):
    """Rows of the animals that train in one fold."""
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "cow")
    return splits.fold_rows(rows, folds(spark, sf), 2, "train", "cow").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("fold_sessions", f"WITH {FOLDS}, s AS (SELECT DISTINCT l_suppkey AS cow, l_returnflag || l_linestatus AS session FROM lineitem) SELECT fold, role, count(DISTINCT session) AS sessions, string_agg(DISTINCT session, ',' ORDER BY session) AS names FROM r JOIN s USING (cow) GROUP BY ALL")
def fold_sessions(spark, sf):
    """Session sets of each block of animals."""
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cow"), F.concat("l_returnflag", "l_linestatus").alias("session"))
    d = splits.fold_sessions(folds(spark, sf), s, "cow", "session")
    return d.select("fold", "role", F.size("sessions").cast("long").alias("sessions"), F.array_join("sessions", ",").alias("names"))
