"""Golden micro-cases of the operators and plain numpy comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import filters, geometry, vocabulary
from kinetrace.operators import daily, features, intervals, labels, metrics, mining, posture, splits, timeline, windows
from kinetrace.sources import recordings, sinks


def series(spark, values, name="v"):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], f"g int, i long, {name} double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def plain_stats(x, lo, hi):
    n, m, s = len(x), [], []
    for i in range(n):
        a, b = min(max(i + lo, 0), n - 1), min(max(i + hi, 1), n)
        b = max(b, a + 1)
        a = min(a, b - 1)
        m.append(np.mean(x[a:b]))
        s.append(np.std(x[a:b]))
    return m, s


@pytest.mark.parametrize(("lo", "hi"), [(-2, 1), (-1, 2), (-20, -10), (10, 20), (-3, 4), (-150, 151)])
def test_window_stats(spark, lo, hi):
    x = np.random.default_rng(0).normal(100, 5, 37)
    mean, sd = windows.mean_and_sd(F.col("v"), ["g"], ["i"], lo, hi)
    narrow = series(spark, x).select("i", mean.alias("m"), sd.alias("s"))
    wide = windows.wide_mean_and_sd(series(spark, x), "v", ["g"], ["i"], lo, hi, "m", "s")
    m, s = plain_stats(x, lo, hi)
    for d in (narrow, wide):
        assert column(d, "m") == pytest.approx(m, abs=1e-9) and column(d, "s") == pytest.approx(s, abs=1e-6)
    sums = features.Sums(x, np.arange(37))
    assert list(sums.mean_sd(lo, hi)[0]) == pytest.approx(m) and list(sums.mean_sd(lo, hi)[1]) == pytest.approx(s, abs=1e-6)


def test_window_golden(spark):
    mean, _ = windows.mean_and_sd(F.col("v"), ["g"], ["i"], -2, 1)
    assert column(series(spark, range(10)).select("i", mean.alias("m")), "m") == [0, 0.5, 1, 2, 3, 4, 5, 6, 7, 8]


@pytest.mark.parametrize(("lo", "hi"), [(-4, 1), (-3, 4), (-30, 31), (2, 5)])
def test_shifted_max(spark, lo, hi):
    x, span = np.random.default_rng(1).normal(0, 1, 23), hi - lo
    trailing = [x[max(0, i - span + 1) : i + 1].max() for i in range(23)]
    want = [trailing[min(i + hi - 1, 22)] for i in range(23)]
    assert column(windows.shifted_max(series(spark, x), "v", ["g"], ["i"], lo, hi, "m"), "m") == want
    assert list(features.window_max(x, np.arange(23), lo, hi)) == want


def test_masks(spark):
    d = spark.createDataFrame([(1, i, i in (3, 4, 5, 6, 50)) for i in range(100)], "g int, i long, m boolean")
    runs = timeline.mask_to_intervals(d, ["g"], "i", F.col("m"))
    assert sorted((r.lo, r.hi) for r in runs.collect()) == [(3, 7), (50, 51)]
    assert sorted(r["index"] for r in timeline.intervals_to_mask(runs, ["g"]).collect()) == [3, 4, 5, 6, 50]


def scores(spark, parts):
    """2 Hz points from (from s, to s, value) parts over 0 - 40 s, base 0.1."""
    rows = []
    for k in range(80):
        t = k * 500
        rows.append((1, t, next((v for a, b, v in parts if a * 1000 <= t < b * 1000), 0.1)))
    return spark.createDataFrame(rows, "g int, t long, v double")


def spans_of(df):
    return sorted((r.start_t, r.end_t) for r in df.collect())


def test_hysteresis_golden(spark):
    p = scores(spark, [(19.5, 20.5, 0.35), (10, 30, 0.9)])
    run = lambda low: spans_of(intervals.assemble_events(p, ["g"], "t", "v", 0.5, low, 750, 500, F.lit(0), F.lit(0)))
    assert len(run(0.5)) == 2 and run(None) == [(10000, 30000)]
    assert intervals.hysteresis(scores(spark, [(0, 40, 0.45)]), ["g"], ["t"], "v", 0.8, 0.3).count() == 0
    with pytest.raises(ValueError, match="low"):
        intervals.hysteresis(p, ["g"], ["t"], "v", 0.3, 0.5)


def test_snapping_golden(spark):
    p = scores(spark, [(10, 30, 0.9)])
    edges = scores(spark, [(9.5, 10.5, 0.9), (29.5, 30.5, 0.9)]).withColumnRenamed("v", "boundary")
    assert spans_of(intervals.assemble_events(p, ["g"], "t", "v", 0.5, None, 750, 500, F.lit(0), F.lit(0), edges)) == [(9500, 29500)]


def test_merge_golden(spark):
    gap, least = vocabulary.MERGE_GAP_MS["URINATION"], vocabulary.MIN_LENGTH_MS["URINATION"]
    run = lambda rows: spans_of(intervals.merge_and_drop(spark.createDataFrame([(1, *r) for r in rows], "g int, start_t long, end_t long"), ["g"], F.lit(gap), F.lit(least)))
    assert run([(0, 20000), (21000, 35000)]) == [(0, 35000)] and run([(0, 500)]) == []
    assert run(run([(0, 9000), (2000, 4000), (14001, 20000)])) == [(0, 9000), (14001, 20000)]


def brute_match(truth, pred, tol=None, least=None):
    c = []
    for i, (a, b) in enumerate(truth):
        for j, (p, q) in enumerate(pred):
            if tol is not None and (o := min(b + tol, q) - max(a - tol, p)) > 0:
                c.append((-o, -i, -j, i, j))
            elif least is not None and (v := max(min(b, q) - max(a, p), 0) / max(max(b, q) - min(a, p), 1)) >= least and v > 0:
                c.append((-v, i, j, i, j))
    out, used = [], (set(), set())
    for *_, i, j in sorted(c):
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            out.append((i, j))
    return sorted(out)


def test_matching_against_brute_force(spark):
    r = np.random.default_rng(4)
    make = lambda n: [(int(s), int(s + d)) for s, d in zip(r.integers(0, 900, n), r.integers(1, 80, n), strict=True)]
    groups = {g: (make(12), make(15)) for g in range(5)}
    t = spark.createDataFrame([(g, i, *x) for g, (a, _) in groups.items() for i, x in enumerate(a)], "g int, ti long, ts long, te long")
    p = spark.createDataFrame([(g, i, *x) for g, (_, b) in groups.items() for i, x in enumerate(b)], "g int, pi long, ps long, pe long")
    read = lambda d: {x.g: sorted((m.t, m.p) for m in x.matches) for x in d.collect()}
    tol, by_iou = read(intervals.match_with_tolerance(t, p, ["g"], 25, 64)), read(intervals.match_by_iou(t, p, ["g"], 0.1, 64))
    for g, (a, b) in groups.items():
        assert tol.get(g, []) == brute_match(a, b, tol=25) and by_iou.get(g, []) == brute_match(a, b, least=0.1)


def test_matching_of_over_a_million_pairs(spark):
    n = 1001
    t = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("ti"), F.lit(0).alias("ts"), F.lit(50).alias("te"))
    p = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("pi"), F.lit(10).alias("ps"), F.lit(60).alias("pe"))
    (got,) = intervals.match_by_iou(t, p, ["g"], 0.1, 64).collect()
    assert sorted((m.t, m.p) for m in got.matches) == [(i, i) for i in range(n)]


def test_iou_golden(spark):
    f1 = lambda p, th: intervals.match_by_iou(spark.createDataFrame([(1, 0, 0, 10000)], "g int, ti long, ts long, te long"), spark.createDataFrame([(1, 0, *p)], "g int, pi long, ps long, pe long"), ["g"], th, 5000).count()
    assert f1((500, 9500), 0.5) == 1 and f1((0, 30000), 0.5) == 0 and f1((0, 30000), 0.25) == 1


def test_threshold_against_brute_force(spark):
    rows, r = [], np.random.default_rng(7)
    for g in range(3):
        y = r.integers(0, 2, 400)
        rows += [(g, int(a), float(round(min(max(0.3 * a + r.random() * 0.7, 0), 1), 2))) for a in y]
    d = spark.createDataFrame([*rows, (9, 1, 0.4), (9, 1, 0.7)], "g int, y int, s double")
    got = {x.g: x for x in metrics.choose_threshold(d, ["g"], "y", "s").collect()}
    for g in range(3):
        own = [(y, s) for k, y, s in rows if k == g]
        f = {c: 2 * sum(y for y, s in own if s >= c) / (sum(s >= c for _, s in own) + sum(y for y, _ in own)) for c in {s for _, s in own}}
        assert got[g].best_f == pytest.approx(max(f.values()), abs=1e-12) and f[got[g].threshold] == pytest.approx(max(f.values()), abs=1e-12)
    assert got[9].threshold == 0.5


def test_edit_score_golden(spark):
    d = spark.createDataFrame([("010", "010"), ("010", "0101010"), ("", "")], "a string, b string")
    assert [round(r[0], 2) for r in d.select(metrics.edit_score(d, "a", "b")).collect()] == [100, 42.86, 100]


def test_selection_and_rates(spark):
    d = spark.range(1)
    assert d.select(metrics.selection_score(F.lit(0.9), F.lit(0.8), F.lit(0.5))).first()[0] == pytest.approx(0.79)
    assert d.select(metrics.selection_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] is None
    verdict = lambda n, h: d.select(metrics.plausibility(F.lit(n), F.lit(h), F.lit(1.5))).first()[0]
    assert verdict(1372, 32.2) == "implausible" and verdict(10, 30.0) == "plausible" and verdict(1, 0.0) == "unknown"


def test_bootstrap_resamples_groups(spark):
    d = spark.createDataFrame([(1, 0.95), (2, 0.4), (3, 0.4), (4, 0.4)], "entity int, v double")
    r = metrics.bootstrap(d, "v", 300).first()
    assert r.groups == 4 and r.high - r.low > 0.1
    assert metrics.bootstrap(d.filter("entity = 1"), "v").first().low is None


def test_mil_golden(spark):
    one = spark.createDataFrame([("a", 0.1)] * 999 + [("a", 0.99)] + [("b", 0.1)] * 900 + [("b", 0.8)] * 100, "d string, s double")
    assert {r.d: r.alert for r in daily.window_scores(one, ["d"], "s").collect()} == {"a": False, "b": True}


def test_baseline_golden(spark):
    d = spark.createDataFrame([("c", f"2024-01-0{i + 1}", 10.0 + i) for i in range(7)], "cow string, day string, x double").withColumn("day", F.to_date("day"))
    r = daily.baseline(d, ["cow"], "x", F.col("day"), F.lit("2024-01-04").cast("date")).first()
    assert r.days == 2 and r.centre > 10
    lone = daily.baseline(d, ["cow"], "x", F.col("day"), F.lit("2024-01-06").cast("date")).collect()
    assert not lone or lone[0].centre is None


@pytest.mark.parametrize(("cows", "k"), [(50, 5), (6, 6), (7, 3)])
def test_folds(spark, cows, k):
    d = spark.createDataFrame([(f"c{i}",) for i in range(cows)], "cow string")
    got = splits.grouped_folds(d, "cow", k).collect()
    test = [(r.fold, r.cow) for r in got if r.role == "test"]
    assert sorted(c for _, c in test) == sorted(f"c{i}" for i in range(cows)) and splits.leaks(splits.grouped_folds(d, "cow", k), "fold", "cow", "role").count() == 0
    for f in range(1, k + 1):
        rest = sorted(r.cow for r in got if r.fold == f and r.role != "test")
        val = sorted(r.cow for r in got if r.fold == f and r.role == "validation")
        assert val == rest[: max(1, round(len(rest) * 0.2))]
    assert splits.protocol(6, 6) == "strict_loco"


def test_mining_guard_and_output(spark):
    p = spark.createDataFrame([(f"s{c}", f"cow{c}", i * 500, 0.9 if 40 <= i < 44 else 0.1 + i / 10000) for c in range(3) for i in range(400)], "session string, cow string, t long, v double")
    with pytest.raises(ValueError, match="random"):
        mining.review_queue(p, ["session"], "cow", "t", "v", random_share=0.0)
    q = mining.numbered(mining.review_queue(p, ["session"], "cow", "t", "v"), ["session", "start_t"]).collect()
    assert {r.sampling_source for r in q} == {"active", "random"} and all(r.review_decision == "" for r in q)
    assert {r.cow for r in q if r.sampling_source == "active"} == {"cow0", "cow1", "cow2"}


def test_labels_and_policies(spark):
    p = spark.createDataFrame([("a", t * 500) for t in range(120)], "g string, t long")
    ann = spark.createDataFrame([("a", "STANDING", 0, 60000), ("a", "URINATION", 10000, 30000), ("a", "TAIL_WAGGING", 1000, 4000)], "g string, code string, start_t long, end_t long")
    d = labels.proxy_masks(labels.label_points(p, ann, ["g"], "t", 10000))
    assert d.filter("event_URINATION = 1").count() == 40 and d.filter("body_target = 0").count() == 120
    for policy, want in {"legacy": (0, 1), "derive": (1, 1), "exclude": (0, 0)}.items():
        e, m = labels.tail_policy(F.col("event_TAIL_RAISED"), F.col("mask_TAIL_RAISED"), F.col("event_URINATION"), policy)
        inside = d.filter("event_URINATION = 1").select(e.alias("e"), m.alias("m")).distinct().collect()
        assert [tuple(r) for r in inside] == [want]
    both = ann.union(spark.createDataFrame([("a", "LYING", 0, 10000)], ann.schema))
    with pytest.raises(Exception, match="two states"):
        labels.label_points(p, both, ["g"], "t", 10000).collect()
    assert labels.label_points(p, both, ["g"], "t", 10000, strict=False).filter("state_conflict").count() == 20


def test_label_grid_and_chunks(spark):
    b = spark.createDataFrame([("s", 0, 0, 3000), ("s", 1, 3000, 5000)], "k string, seg int, lo long, hi long")
    assert timeline.label_grid(b, ["k", "seg"], "lo", "hi", 25).count() == 200
    r = spark.createDataFrame([(i, n) for i, n in enumerate((1, 2, 1200, 1201, 1320, 2300))], "r int, n long")
    got = {}
    for x in timeline.chunk_index(r, ["r"], "n").orderBy("r", "start").collect():
        got.setdefault(x.r, []).append((x.start, x.stop))
    assert got == {1: [(0, 2)], 2: [(0, 1200)], 3: [(0, 1200), (1080, 1201)], 4: [(0, 1200), (1080, 1320)], 5: [(0, 1200), (1080, 2280), (2160, 2300)]}


def test_boundary_targets(spark):
    d = spark.createDataFrame([(1, i, "a" if i < 10 else "b") for i in range(20)], "g int, i long, s string")
    assert [r.i for r in timeline.boundary_targets(d, ["g"], ["i"], "s").filter("boundary = 1").orderBy("i").collect()] == list(range(7, 13))


@pytest.mark.parametrize(("cut", "gain", "radius"), [(0.3, 1.2023116209e-07, 0.98567912), ((0.5, 2.0), 6.2386983548e-05, 0.98494838), ((2.0, 5.0), 8.0635986504e-04, 0.95737669), ((5.0, 15.0), 4.6582906636e-02, 0.86410209)])
def test_filter_design(cut, gain, radius):
    s = filters.butterworth(4, cut, 50.0)
    assert np.prod(s[:, 0]) == pytest.approx(gain, rel=1e-8) and np.sqrt(s[:, 5].max()) == pytest.approx(radius, rel=1e-7)


def test_filter_blocks_equal_recursion_and_zero_phase_keeps_constants():
    x, s = np.random.default_rng(2).normal(0, 1, 1000), filters.butterworth(4, (2.0, 5.0), 50.0)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in s:
        p, out = [0.0, 0.0], []
        for v in y:
            o = b0 * v + p[0]
            p = [b1 * v - a1 * o + p[1], b2 * v - a2 * o]
            out.append(o)
        y = np.array(out)
    assert filters.forward(s, x) == pytest.approx(y, abs=1e-10)
    low = filters.butterworth(4, 0.3, 50.0)
    assert filters.zero_phase(low, np.full(500, 3.0)) == pytest.approx(np.full(500, 3.0), abs=1e-6)
    static, dyn = filters.gravity_split(np.ones((20, 3)), True)
    assert (static == 1).all() and (dyn == 0).all()


def motion(n, lever=1.0, seed=0, tilt=0.0):
    r, t = np.random.default_rng(seed), np.arange(n) / 50
    acc = np.stack([np.full(n, np.sin(tilt)), np.zeros(n), np.full(n, np.cos(tilt))], axis=1) + r.normal(0, 0.02, (n, 3))
    gyro = lever * 30 * np.sin(2 * np.pi * 1.8 * t)[:, None] * np.array([1, 0.5, 0.2]) + r.normal(0, 0.5, (n, 3))
    return np.concatenate([acc, gyro], axis=1)


from .test_features import plain_reference  # noqa: E402


def bank(block, version=2, causal=True, ref=None):
    unit, scale, _ = ref or plain_reference([block], causal)
    return features.bank(block, np.zeros(len(block)), np.arange(0, len(block), 25), causal, unit, scale, version)


def test_feature_bank_contracts():
    assert (len(features.names(1)), len(features.names(2)), len(set(features.names(2)))) == (104, 120, 120)
    one, two, big = bank(motion(3000), 1), bank(motion(3000)), bank(motion(3000, 3.0))
    assert all(np.isfinite(v).all() for v in two.values()) and len(two["tilt_mean_5s"]) == 120
    assert all((one[k] == two[k]).all() for k in one if "gyro" not in k and "band" not in k) and not np.allclose(one["gyro_norm_mean_5s"], two["gyro_norm_mean_5s"])
    ratio = lambda v: float(np.median(bank(motion(3000, 3.0), v)["gyro_norm_mean_5s"][40:]) / np.median(bank(motion(3000), v)["gyro_norm_mean_5s"][40:]))
    assert ratio(1) > 2.5 and abs(ratio(2) - 1) < 0.15 and len(big) == 120


def test_causal_features_ignore_the_future():
    a = motion(6000)
    b, ref = a.copy(), (np.array([0.0, 0.0, 1.0]), 5.0, 1.0)
    b[5000:] += 3
    x, y = bank(a, ref=ref), bank(b, ref=ref)
    early = np.arange(0, 6000, 25) < 4500
    assert all((x[k][early] == y[k][early]).all() for k in x) and not (x["tilt_mean_1s"] == y["tilt_mean_1s"]).all()


def test_feature_plan(spark):
    m = motion(1000)
    rows = [(f"s{k}", 0, i, *map(float, v), 0) for k in range(2) for i, v in enumerate(m)]
    d = spark.createDataFrame(rows, "cache_key string, segment_id int, frame_index long, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double, quality int")
    got, want = features.build(d.repartition(5)).filter("cache_key = 's1'").orderBy("center_index").collect(), bank(m)
    assert len(got) == 40
    for k in features.names(2):
        assert [getattr(r, k) for r in got] == pytest.approx(list(want[k]), rel=1e-4, abs=1e-5), k


def test_rotation(spark):
    for v in ((0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.6, 0.0, 0.8), (0.48, 0.6, -0.64)):
        m = np.array([[c for c in r] for r in features.to_z(np.array(v))])
        assert m @ np.array(v) == pytest.approx([0, 0, 1], abs=1e-9) and np.linalg.det(m) == pytest.approx(1)
        got = spark.range(1).select(*[c for r in geometry.rotation_to_z([F.lit(x) for x in v]) for c in r]).first()
        assert list(got) == pytest.approx(list(m.reshape(-1)), abs=1e-12)
    assert len(geometry.simplex(3, 4)) == 15 and geometry.simplex(1) == [(1.0,)]


def test_decode(spark, tmp_path):
    import base64
    import json

    f = np.zeros(300, recordings.FRAME)
    f["ms"], f["v"] = np.arange(300) * 20 + 5, np.arange(2700).reshape(300, 9)
    good = b"\x01\x02\x03\x04\x05" + f.tobytes() + b"\x07" * 3
    text = base64.b64encode(good).decode()
    for name, doc in {"a": {"imu": text[:50] + "\n " + text[50:], "device": "d", "create_time": 7}, "b": {"imu": ""}, "c": {"imu": base64.b64encode(b"\x00" * 500).decode()}}.items():
        (tmp_path / f"{name}.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(doc).encode())
    d = recordings.read_json(spark, str(tmp_path)).withColumn("k", F.regexp_extract("path", "([a-z])\\.json", 1))
    frames, notes = recordings.decode_frames(d, "k")
    n = {r.k: r for r in notes.collect()}
    assert (n["a"].frame_offset, n["a"].dropped_prefix, n["a"].dropped_trailing, n["a"].frames, n["a"].error) == (5, 5, 3, 300, None)
    assert n["b"].error and n["c"].error and frames.count() == 300
    assert frames.orderBy("elapsed_ms").first().acc_y == 1
    assert {r.k: r.error for r in d.collect()}["b"] == "missing imu field"


def test_cache_round_trip(spark, tmp_path):
    rows = [("k", "cow", i, *[int(x) for x in np.arange(9) * 100 + i]) for i in range(400)]
    d = spark.createDataFrame(rows, "cache_key string, cow_id string, frame_index long, " + ", ".join(f"{c} int" for c in recordings.RAW_CHANNELS))
    recordings.write_cache(d, str(tmp_path / "c"))
    assert recordings.read_cache(spark, str(tmp_path / "c"), 30, 43).count() == 13
    flagged = spark.createDataFrame([("k", 30, 43)], "cache_key string, lo long, hi long")
    q = recordings.with_quality(recordings.read_cache(spark, str(tmp_path / "c")), flagged)
    assert q.agg(F.sum("quality")).first()[0] == 13 and q.count() == 400
    assert spark.range(1).select(recordings.frame_time(F.lit(900000), F.lit(250), F.lit(250))).first()[0] == 900000
    with pytest.raises(Exception, match="exist"):
        recordings.write_cache(d, str(tmp_path / "c"))
    with pytest.raises(Exception, match="16-bit"):
        recordings.write_cache(d.withColumn("acc_x", F.lit(40000)), str(tmp_path / "bad"))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1)], "k string, i int")
    sinks.write_table(d, str(tmp_path / "t"), {"rows": 3}, "csv")
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 3 and sinks.read_json(spark, str(tmp_path / "t.manifest")) == {"rows": 3}
    assert sinks.optional_table(spark, str(tmp_path / "none")) is None
    assert [r.sample_id for r in sinks.sample_ids(d, ["k"], ["i"]).orderBy("k", "i").collect()] == ["SMP-0000001", "SMP-0000002", "SMP-0000003"]
    assert sinks.markdown([{"a": 1}]).splitlines() == ["| a |", "|---|", "| 1 |"]


def plain_machine(rows, c):
    state, asking, dwell, out = int(rows[0][1] > rows[0][0]), 0, c.dwell, []
    for i, (u, ly, up, down) in enumerate(rows):
        if i:
            a, b = ly + c.event_weight * down, u + c.event_weight * up
            other = a > b + c.margin if state == 0 else b > a + c.margin
            asking = asking + 1 if other else 0
            if other and dwell >= c.dwell and asking >= c.confirm:
                state, asking, dwell = 1 - state, 0, 0
            dwell += 1
        out.append(state)
    return out


def test_state_machine_and_tuning(spark):
    r = np.random.default_rng(3)
    p = np.clip(np.repeat(r.random(12), 10) * 0.6 + r.random(120) * 0.4, 0, 1)
    rows = [("a", i * 500 + (10_000 if i >= 60 else 0), float(1 - v), float(v), 0.1, 0.2, int(v > 0.5)) for i, v in enumerate(p)]
    d = spark.createDataFrame(rows, "g string, t long, upright double, lying double, up double, down double, y int")
    got = column(posture.smooth(d, ["g"], "t"), "state_sm", "t")
    halves = [[x[2:6] for x in rows[:60]], [x[2:6] for x in rows[60:]]]
    assert got == [s for h in halves for s in plain_machine(h, posture.Machine())]
    grid = posture.GRID[::37]
    tuned = {x.machine: x for x in posture.tune(d, ["g"], "t", "y", grid=grid).collect()}
    for i, m in enumerate(grid):
        s = [v for h in halves for v in plain_machine(h, m)]
        assert tuned[i].c11 == sum(a == b == 1 for a, b in zip(s, (x[6] for x in rows), strict=True))
    assert sum(x.best for x in tuned.values()) == 1


def test_vocabulary(spark):
    d = spark.createDataFrame([(" Yes ", " ROOT", "a b/c.json"), ("0", "else", "/")], "f string, p string, path string")
    got = d.select(vocabulary.truthy(F.col("f")), vocabulary.ring_position(F.col("p")), vocabulary.cache_key(F.col("path"))).collect()
    assert [(r[0], r[1]) for r in got] == [(True, "root"), (False, "unknown")] and got[0][2].startswith("a_b_c_json_")
    assert vocabulary.events_table(spark).filter("trained").count() == 7
    with pytest.raises(Exception, match="threshold"):
        d.select(vocabulary.resolved_threshold(F.lit(1.5), F.lit(0.4))).collect()
    assert d.select(vocabulary.resolved_threshold(F.lit(None).cast("double"), F.lit(0.4))).first()[0] == 0.4


def test_stream_equals_batch(spark):
    from kinetrace.plans import learning, signal

    sf = "/root/testdata/sf0.001"
    a, b = learning.stream_state_machine(spark, sf), signal.state_machine(spark, sf).drop("state_raw")
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 0


@pytest.mark.parametrize("slice_rows", [50, 10_000])
def test_stream_keeps_tied_times(spark, monkeypatch, slice_rows):
    from kinetrace.plans import learning
    from kinetrace.streaming import causal

    monkeypatch.setattr(learning, "SLICE", slice_rows)
    r, machine = np.random.default_rng(3), posture.Machine(2, 2, 0.1, 0.5, 5)
    rows = [(int(g), int(t), *map(float, r.random(4))) for g, t in zip(r.integers(0, 2, 300), r.integers(0, 150, 300), strict=True)]
    d = spark.createDataFrame(rows, "g long, t long, upright double, lying double, up double, down double")
    a = learning.replay(spark, d, "posture", lambda s: causal.state_machine(s, "g", "t", machine), ["g"], "t")
    b = posture.smooth(d, ["g"], "t", machine).select("g", "t", "state_sm")
    assert a.count() == len(rows) and a.exceptAll(b).count() == 0
    p = spark.createDataFrame([(1, 10, 0.1), (1, 10, 0.9), (1, 12, 0.9), (1, 12, 0.2), (1, 60, 0.1)], "g long, t long, v double")
    got = learning.replay(spark, p, "runs", lambda s: causal.positive_runs(s, "g", "t", "v", 0.5, 5, 1), ["g"], "t").collect()
    assert [tuple(x) for x in got] == [(1, 10, 13)]


def test_boosted_task(spark, tmp_path):
    from kinetrace.models import boosting

    r = np.random.default_rng(5)
    rows = [(f"c{i % 6}", float(x), float(z), int(x > 0.6)) for i, (x, z) in enumerate(r.random((600, 2)))]
    d = spark.createDataFrame(rows, "cow_id string, f1 double, f2 double, event_A int")
    fast = boosting.Settings(trees=3, rate=0.5, depth=2)
    task = boosting.train(d, "A", "event_A", "cow_id", settings=fast)
    assert task.features == ["f1", "f2"] and task.threshold_source == "held-out animals" and task.importance()[0][0] == "f1"
    task.save(str(tmp_path / "task"))
    back = boosting.Task.load(spark, str(tmp_path / "task"))
    out = boosting.predict(d, [back], {"A": 0.7})
    assert out.filter("(prob_A >= threshold_A) <> (event_A = 1)").count() < 30 and out.first().threshold_A == 0.7
    with pytest.raises(ValueError, match="missing"):
        task.score(d.drop("f1"))
    assert boosting.train(d.limit(40), "A", "event_A", "cow_id", settings=fast) is None


def test_chunks_with_halo():
    from kinetrace.models.onnx import chunks

    for steps, size, halo in ((10, 4, 2), (7, 7, 3), (1, 5, 9), (23, 5, 100)):
        kept = [k for lo, hi, a, b in chunks(steps, size, halo) for k in range(lo + a, lo + b)]
        assert kept == list(range(steps)) and all(0 <= lo <= hi <= steps for lo, hi, *_ in chunks(steps, size, halo))


def test_legacy_caches(spark, tmp_path):
    import json

    from kinetrace.sources import legacy

    for key, kind in (("one", "i2"), ("two", "f4")):
        (tmp_path / key).mkdir()
        np.save(tmp_path / key / "signal.npy", np.arange(120).reshape(10, 12).astype(kind))
        (tmp_path / key / "metadata.json").write_text(json.dumps({"schema_version": 2, "cow_id": "c", "frames": 10}))
    d = legacy.read_arrays(spark, str(tmp_path))
    assert d.count() == 20 and d.filter("cache_key = 'two' AND frame_index = 3").first().acc_y == 37
    assert legacy.read_documents(spark, str(tmp_path)).first().segments[0].stop_index == 10
    with pytest.raises(ValueError, match="cache key"):
        legacy.checked_key("../x")


def test_command_line(spark, tmp_path, capsys):
    from kinetrace import cli

    assert cli.main(["plan-storage", "--cows", "200", "--days", "7"]) == 0
    r = __import__("json").loads(capsys.readouterr().out)
    assert r["frames"] == 200 * 7 * 24 * 3600 * 50 and 95 < r["gib_schema2"] < 110 and r["ratio"] > 2.5
    spark.createDataFrame([("e", "x", "c1", "s", 0, 5), ("e", "x", "c1", "s", 5, 5)], "event_id string, code string, cow_id string, session_id string, t_start_rel_ms long, t_end_rel_ms long").write.parquet(str(tmp_path / "a"))
    assert cli.main(["check-data", str(tmp_path / "a")]) == 1
    spark.createDataFrame([(f"c{i}", "included") for i in range(5)], "cow_id string, status string").write.parquet(str(tmp_path / "s"))
    assert cli.main(["make-splits", str(tmp_path / "s"), str(tmp_path / "folds")]) == 0
    assert spark.read.parquet(str(tmp_path / "folds")).count() == 25
