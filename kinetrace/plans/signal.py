"""Queries over raw frames, geometry, filters and features. The filters have no SQL form; tests compare them with plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, geometry
from ..operators import features, metrics, posture
from ..sources import recordings
from ..sources.scratch import written
from ..sources.tables import HOUR, POINTS, SAMPLES, points, samples, table
from .catalog import query

ACC = "CAST(embedding[{}] AS DOUBLE)"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz"))])


V = "v AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz"))) + " FROM embeddings)"


def xyz(kind: str):
    return [F.col(f"{kind}{c}") for c in "xyz"]


@query("calibrate_rotate", f"WITH {V} SELECT vec_id, round((ax - 0.01) / 4.096, 9) AS acc_x, round(ay / 4.096, 9) AS acc_y, round((az + 0.02) / 4.096, 9) AS acc_z, round(gx / 32, 9) AS gyro_x, round(my / 1000, 9) AS mag_x, round(-mx / 1000, 9) AS mag_y, round(mz / 1000, 9) AS mag_z FROM v")
def calibrate_rotate(spark, sf):
    acc = geometry.calibrated(xyz("a"), F.lit(4.096), [F.lit(0.01), F.lit(0.0), F.lit(-0.02)])
    gyro, mag = geometry.calibrated(xyz("g"), F.lit(32.0)), [m / 1000 for m in geometry.magnetometer_to_body(xyz("m"))]
    named = dict(zip(("acc_x", "acc_y", "acc_z", "gyro_x", "mag_x", "mag_y", "mag_z"), [*acc, gyro[0], *mag], strict=True))
    return vectors(spark, sf).select("vec_id", *[F.round(c, 9).alias(k) for k, c in named.items()])


@query("tilt_angles", f"WITH {V}, n AS (SELECT *, greatest(sqrt(ax * ax + ay * ay + az * az), 1e-9) AS n FROM v) SELECT vec_id, round(degrees(acos(least(greatest(az / n, -1), 1))), 6) AS tilt, round(degrees(atan2(ax, sqrt(ay * ay + az * az))), 6) AS pitch, round(degrees(atan2(ay, sqrt(ax * ax + az * az))), 6) AS roll FROM n")
def tilt_angles(spark, sf):
    pitch, roll = geometry.pitch_roll(xyz("a"))
    return vectors(spark, sf).select("vec_id", F.round(geometry.degrees_between_z(geometry.unit(xyz("a"))[2]), 6).alias("tilt"), F.round(pitch, 6).alias("pitch"), F.round(roll, 6).alias("roll"))


@query("rotation_to_z", f"WITH {V}, n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM v), u AS (SELECT vec_id, ax / n AS x, ay / n AS y, az / n AS c, gx, gy, gz FROM n), k AS (SELECT *, (1 - c) / (x * x + y * y) AS k FROM u) SELECT vec_id, round((1 - x * x * k) * gx - x * y * k * gy - x * gz, 6) AS rx, round(-x * y * k * gx + (1 - y * y * k) * gy - y * gz, 6) AS ry, round(x * gx + y * gy + c * gz, 6) AS rz FROM k")
def rotation_to_z(spark, sf):
    r = geometry.apply(geometry.rotation_to_z(geometry.unit(xyz("a"))), xyz("g"))
    return vectors(spark, sf).select("vec_id", *[F.round(c, 6).alias(k) for k, c in zip(("rx", "ry", "rz"), r, strict=True)])


@query("rotation_invariants", f"WITH {V}, c AS (SELECT *, ay * gz - az * gy AS cx, az * gx - ax * gz AS cy, ax * gy - ay * gx AS cz FROM v) SELECT vec_id, round(ax * gx + ay * gy + az * gz, 9) AS acc_dot_gyro, round(sqrt(cx * cx + cy * cy + cz * cz), 9) AS acc_cross_gyro FROM c")
def rotation_invariants(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(geometry.dot(xyz("a"), xyz("g")), 9).alias("acc_dot_gyro"), F.round(geometry.norm(geometry.cross(xyz("a"), xyz("g"))), 9).alias("acc_cross_gyro"))


FUSED = f"{POINTS}, f AS (SELECT id, id % 5 = 0 AS y, ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS a, ln((id % 89 + 1) / 91.0 / (1 - (id % 89 + 1) / 91.0)) AS b FROM p), w AS (SELECT range / 10.0 AS w FROM range(11)), z AS (SELECT w, y, round(w * a + (1 - w) * b, 6) AS z FROM f, w), s AS (SELECT w, z, count(*) FILTER (y) AS pos, count(*) AS n FROM z GROUP BY ALL), k AS (SELECT w, pos, sum(pos) OVER o AS tp, sum(n) OVER o AS called, sum(pos) OVER (PARTITION BY w) AS positives FROM s WINDOW o AS (PARTITION BY w ORDER BY z DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT w, sum(pos / positives * tp / called) AS ap FROM k GROUP BY w)"


@query("late_fusion", f"WITH {FUSED} SELECT w AS weight, round(ap, 9) AS average_precision, w = (SELECT max_by(w, (round(ap, 12), -w)) FROM ap) AS best FROM ap")
def late_fusion(spark, sf):
    """Two branches' logits on a weight grid, scored by average precision."""
    p = points(spark, sf).select((F.col("id") % 5 == 0).cast("int").alias("y"), geometry.logit(F.col("score")).alias("a"), geometry.logit((F.col("id") % 89 + 1) / 91.0).alias("b"))
    grid = F.array(*[F.lit(w[0]) for w in geometry.simplex(2)])
    z = p.withColumn("weight", F.explode(grid)).select("weight", "y", F.round(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"), 6).alias("z"))
    ap = metrics.average_precision(z, ["weight"], "y", "z")
    best = ap.agg(F.max_by("weight", F.struct(F.round("average_precision", 12), -F.col("weight"))).alias("top"))
    return ap.join(F.broadcast(best), F.lit(True)).select("weight", F.round("average_precision", 9).alias("average_precision"), (F.col("weight") == F.col("top")).alias("best"))


def payloads(spark, sf):
    """Lines per supplier as packed 50 Hz frames, with three bytes of rubbish in front."""
    s = samples(spark, sf).withColumn("i", F.row_number().over(posture.over(["entity"], ["k0", "k1", "k2", "k3", "y"])))
    n = F.col("x").cast("long")
    frame = recordings.packed(F.col("i") * 20, [n, -n, n * 100, n * 7 - 200, F.col("k2"), -F.col("k2"), F.col("i") % 300, F.col("i") % 7, n - n])
    f = s.select("entity", F.struct("i", frame.alias("f")).alias("s")).groupBy("entity").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return f.select("entity", F.concat(F.unhex(F.lit("0A0B0C")), recordings.joined(F.col("s.f"))).alias("payload"))


@query("decode_frames", f"WITH {SAMPLES}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k0, k1, k2, k3, y) AS i FROM s) SELECT entity, i * 20 AS elapsed_ms, x::INT AS acc_x, -x::INT AS acc_y, (x * 100)::INT AS acc_z, (x * 7 - 200)::INT AS gyro_x, k2 AS gyro_y, -k2 AS gyro_z, i % 300 AS mag_raw_x, i % 7 AS mag_raw_y, 0 AS mag_raw_z FROM i")
def decode_frames(spark, sf):
    frames, _ = recordings.decode_frames(payloads(spark, sf), "entity")
    return frames.drop("place")


@query("decode_diagnostics", "SELECT l_suppkey AS entity, 3 AS frame_offset, 3 AS dropped_prefix, 0 AS dropped_trailing, 1.0::DOUBLE AS score, count(*) AS frames, NULL AS error FROM lineitem GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT l_suppkey, NULL, NULL, NULL, NULL, 0, 'payload too short' FROM lineitem GROUP BY 1 HAVING count(*) < 10")
def decode_diagnostics(spark, sf):
    _, notes = recordings.decode_frames(payloads(spark, sf), "entity")
    return notes.withColumn("score", F.round("score", 9))


def signal(spark, sf):
    """A 50 Hz signal per supplier made of its lines: one gravity axis, motion from the rest."""
    s = samples(spark, sf).withColumn("i", (F.row_number().over(posture.over(["entity"], ["k0", "k1", "k2", "k3", "y"])) - 1).cast("long"))
    wave = lambda k, a: F.sin(F.col("i") * k) * a * F.col("x") / 50
    return s.select(
        F.concat(F.lit("s"), F.col("entity")).alias("cache_key"), F.lit(0).alias("segment_id"), F.col("i").alias("frame_index"), wave(0.21, 0.1).alias("acc_x"), wave(0.13, 0.2).alias("acc_y"), (1 + wave(0.31, 0.05)).alias("acc_z"),
        wave(0.17, 40).alias("gyro_x"), wave(0.23, 30).alias("gyro_y"), wave(0.41, 20).alias("gyro_z"), (F.col("k2") == 1).cast("int").alias("quality"),
    )


def gravity_sql() -> str:
    """Recursive SQL of the causal gravity filter: section after section, sample by sample (under 64 samples: the mean)."""
    axes = [f"{a}{k}" for a in "xyz" for k in range(2)]
    start, step, carry = [], [], []
    for a in "xyz":
        x = f"n.{a}"
        for k, (b0, b1, b2, _, a1, a2) in enumerate(filters.butterworth(4, 0.3, 50.0).tolist()):
            v = f"{a}{k}"
            first, now = (f"{b0!r}::DOUBLE * ({x})",) * 2
            now += f" + g.p{v}"
            start.append((v, first))
            step.append((v, now))
            carry += [(f"p{v}", f"{b1!r}::DOUBLE * ({{x{v}}}) - {a1!r}::DOUBLE * {{y{v}}} + {{q{v}}}"), (f"q{v}", f"{b2!r}::DOUBLE * ({{x{v}}}) - {a2!r}::DOUBLE * {{y{v}}}")]
            x = f"w{v}"
    inputs = {f"x{a}{k}": a if k == 0 else f"w{a}0" for a in "xyz" for k in range(2)}

    def layer(source: str, values: list[tuple[str, str]], q: str) -> str:
        inner = ", ".join(f"{e} AS w{v}" for v, e in values)
        after = ", ".join(e.format(**inputs, **{f"y{v}": f"w{v}" for v in axes}, **{f"q{v}": q.format(v=v) for v in axes}) + f" AS {name}" for name, e in carry)
        return f"SELECT cache_key, i, {', '.join(f'w{v} AS {v}' for v in axes)}, {after} FROM (SELECT n.cache_key, n.i, n.x, n.y, n.z, {inner}{'' if q == '0.0::DOUBLE' else ', ' + ', '.join(f'g.q{v} AS old{v}' for v in axes)} FROM {source})"

    return f"""z AS (SELECT 's' || entity AS cache_key, row_number() OVER (PARTITION BY entity ORDER BY k0, k1, k2, k3, y) - 1 AS i, x AS v, k2 FROM s),
n AS (SELECT cache_key, i, sin(i * 0.21) * 0.1 * v / 50 AS x, sin(i * 0.13) * 0.2 * v / 50 AS y, 1 + sin(i * 0.31) * 0.05 * v / 50 AS z, sin(i * 0.17) * 40 * v / 50 AS gx, sin(i * 0.23) * 30 * v / 50 AS gy, sin(i * 0.41) * 20 * v / 50 AS gz FROM z),
g AS ({layer("n WHERE n.i = 0", start, "0.0::DOUBLE")} UNION ALL {layer("g JOIN n ON n.cache_key = g.cache_key AND n.i = g.i + 1", step, "old{v}")}),
m AS (SELECT cache_key, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM n GROUP BY 1),
st AS (SELECT n.*, m.n, CASE WHEN m.n < 64 THEN m.x ELSE g.x1 END AS sx, CASE WHEN m.n < 64 THEN m.y ELSE g.y1 END AS sy, CASE WHEN m.n < 64 THEN m.z ELSE g.z1 END AS sz FROM n JOIN g USING (cache_key, i) JOIN m USING (cache_key))"""


GRAVITY = f"WITH RECURSIVE {SAMPLES}, {gravity_sql()}"


@query("gravity_split", GRAVITY + " SELECT cache_key, i AS frame_index, round(sx, 6) AS sx, round(sy, 6) AS sy, round(sz, 6) AS sz FROM st")
def gravity_split(spark, sf):
    """Static acceleration of each segment."""

    def run(key, t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("frame_index")
        static, _ = filters.gravity_split(np.column_stack([t.column(c).to_numpy() for c in ("acc_x", "acc_y", "acc_z")]), causal=True)
        return pa.table([t.column("cache_key"), t.column("frame_index"), *map(pa.array, static.T)], names=["cache_key", "frame_index", "sx", "sy", "sz"])

    d = signal(spark, sf).select("cache_key", "segment_id", "frame_index", "acc_x", "acc_y", "acc_z").groupBy("cache_key", "segment_id").applyInArrow(run, "cache_key string, frame_index long, sx double, sy double, sz double")
    return d.select("cache_key", "frame_index", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "sz")])


@query("session_reference", GRAVITY + """,
t AS (SELECT cache_key, sx, sy, sz, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS motion, sqrt(gx * gx + gy * gy + gz * gz) AS rate FROM st WHERE i % 10 = 0 AND n >= 32),
e AS (SELECT *, quantile_cont(motion, 0.3) OVER (PARTITION BY cache_key) AS edge, count(*) OVER (PARTITION BY cache_key) AS k FROM t), f AS (SELECT *, count(*) FILTER (motion <= edge) OVER (PARTITION BY cache_key) AS still FROM e),
r AS (SELECT cache_key, median(sx) FILTER (motion <= edge OR still < 10) AS ux, median(sy) FILTER (motion <= edge OR still < 10) AS uy, median(sz) FILTER (motion <= edge OR still < 10) AS uz, quantile_cont(rate, 0.9) AS high, any_value(k) AS k, avg((motion <= edge OR still < 10)::INT) AS quiet FROM f GROUP BY 1), u AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS size FROM r)
SELECT cache_key, round(ux / size, 6) AS ux, round(uy / size, 6) AS uy, round(uz / size, 6) AS uz, round(CASE WHEN k >= 10 THEN greatest(high, 5) ELSE 1 END, 6) AS gyro_scale, round(quiet, 6) AS quiet FROM u""")
def session_reference(spark, sf):
    """Gravity direction and amplitude scale per session."""
    d = features.references(signal(spark, sf), "cache_key", "segment_id", "frame_index", True)
    return d.select("cache_key", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("feature_bank")
def feature_bank(spark, sf):
    """The 120 causal features at the decision points."""
    return features.build(written(signal(spark, sf), "feature-signal"))


@query("bandpass_energy")
def bandpass_energy(spark, sf):
    """Band energies of the feature bank, centred windows, version 1."""
    d = features.build(written(signal(spark, sf), "feature-signal"), causal=False, version=1)
    return d.select("cache_key", "segment_id", "center_index", *[f"band_{b}_energy_mean_5s" for b in features.BANDS])


def postures(spark, sf):
    p = points(spark, sf)
    return p.select("entity", "t", (1 - F.col("score")).alias("upright"), F.col("score").alias("lying"), ((F.col("id") % 7) / 7).alias("up"), ((F.col("id") % 5) / 5).alias("down"), (F.col("id") % 2).cast("int").alias("target"))


MACHINE = posture.Machine(2, 2, 0.1, 0.5, 24 * HOUR)


def machine_sql(settings: str, extra: str = "") -> str:
    """Recursive SQL of the posture machine; ``settings`` is a table (machine, confirm, dwell_min, margin, weight)."""
    order = "PARTITION BY entity ORDER BY t, upright, lying, up, down"
    return f"""WITH RECURSIVE {POINTS}, o AS (SELECT entity, t, 1 - score AS upright, score AS lying, (id % 7) / 7 AS up, (id % 5) / 5 AS down, id % 2 AS target FROM p), d AS (SELECT *, t - lag(t) OVER ({order}) AS step FROM o),
b AS (SELECT *, sum(CASE WHEN step <= 0 OR step > {24 * HOUR} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS run FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY entity, run ORDER BY t) AS i FROM b), c AS ({settings}),
m AS (SELECT machine, entity, run, i, (lying > upright)::INT AS state, 0 AS asking, dwell_min AS dwell FROM r, c WHERE i = 1 UNION ALL
SELECT machine, entity, run, i, CASE WHEN turn THEN 1 - state ELSE state END, CASE WHEN turn THEN 0 ELSE ask END, CASE WHEN turn THEN 1 ELSE dwell + 1 END FROM (
SELECT m.machine, r.entity, r.run, r.i, m.state, m.dwell, CASE WHEN m.state = 0 THEN lying + weight * down > upright + weight * up + margin ELSE upright + weight * up > lying + weight * down + margin END AS other,
CASE WHEN other THEN m.asking + 1 ELSE 0 END AS ask, other AND m.dwell >= dwell_min AND m.asking + 1 >= confirm AS turn FROM m JOIN r ON r.entity = m.entity AND r.run = m.run AND r.i = m.i + 1 JOIN c ON c.machine = m.machine)){extra}"""


ONE = "SELECT 0 AS machine, 2 AS confirm, 2 AS dwell_min, 0.1::DOUBLE AS margin, 0.5::DOUBLE AS weight"
SMOOTHED = machine_sql(ONE, ", q AS (SELECT entity, t, (lying > upright)::INT AS state_raw, state AS state_sm, target FROM m JOIN r USING (entity, run, i))")


@query("state_machine", SMOOTHED + " SELECT entity, t, state_raw, state_sm FROM q")
def state_machine(spark, sf):
    """Raw and confirmed posture per point."""
    return posture.smooth(postures(spark, sf), ["entity"], "t", MACHINE).select("entity", "t", "state_raw", "state_sm")


@query("state_scores", SMOOTHED + """, k AS (SELECT 'state_raw' AS states, target AS y, state_raw AS p FROM q UNION ALL SELECT 'state_sm', target, state_sm FROM q),
f AS (SELECT states, c.range AS c, count(*) FILTER (y = c.range AND p = c.range) AS tp, count(*) FILTER (y = c.range) AS yes, count(*) FILTER (p = c.range) AS said, count(*) AS n FROM k, range(2) c GROUP BY ALL)
SELECT states, any_value(n) AS evaluated, round(avg(coalesce(2 * tp / nullif(yes + said, 0), 0)), 9) AS macro_f1 FROM f GROUP BY states""")
def state_scores(spark, sf):
    """Macro F1 of the raw and the confirmed states."""
    d = posture.smooth(postures(spark, sf), ["entity"], "t", MACHINE)
    return posture.state_scores(d, "target").withColumn("macro_f1", F.round("macro_f1", 9))


@query("state_changes", SMOOTHED + ", w AS (SELECT coalesce(state_raw <> lag(state_raw) OVER (PARTITION BY entity ORDER BY t), false)::INT AS a, coalesce(state_sm <> lag(state_sm) OVER (PARTITION BY entity ORDER BY t), false)::INT AS b FROM q) SELECT sum(a)::BIGINT AS state_raw_changes, sum(b)::BIGINT AS state_sm_changes FROM w")
def state_changes(spark, sf):
    """How often either state changes along an animal's points."""
    d = posture.smooth(postures(spark, sf), ["entity"], "t", MACHINE)
    return posture.state_changes(d, ["entity"], "t", ["state_raw", "state_sm"])


GRID_SQL = "SELECT row_number() OVER () - 1 AS machine, confirm, dwell_min, margin, weight FROM (SELECT unnest([2, 4, 6, 10]) AS confirm), (SELECT unnest([2, 4, 10, 20]) AS dwell_min), (SELECT unnest([0.0, 0.1, 0.2, 0.3]::DOUBLE[]) AS margin), (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS weight)"


@query("tune_state_machine", machine_sql("SELECT confirm * 1000000 + dwell_min * 10000 + round(margin * 10) * 100 + round(weight * 4) AS machine, confirm, dwell_min, margin, weight FROM (" + GRID_SQL + ")", """,
k AS (SELECT machine, count(*) FILTER (target = 0 AND state = 0) AS c00, count(*) FILTER (target = 0 AND state = 1) AS c01, count(*) FILTER (target = 1 AND state = 0) AS c10, count(*) FILTER (target = 1 AND state = 1) AS c11 FROM m JOIN r USING (entity, run, i) GROUP BY 1),
f AS (SELECT *, (coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0)) / 2 AS f1 FROM k JOIN c USING (machine))
SELECT confirm, dwell_min AS dwell, margin, weight AS event_weight, c00, c01, c10, c11, round(f1, 9) AS macro_f1, row_number() OVER (ORDER BY f1 DESC, confirm + dwell_min, confirm, dwell_min, margin, weight) = 1 AS best FROM f"""))
def tune_state_machine(spark, sf):
    """All 256 settings in one grouped pass."""
    d = posture.tune(postures(spark, sf), ["entity"], "t", "target", gap=24 * HOUR)
    return d.select("confirm", "dwell", "margin", "event_weight", "c00", "c01", "c10", "c11", F.round("macro_f1", 9).alias("macro_f1"), "best")
