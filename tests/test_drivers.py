"""Whole runs, event reports, augmentation, checks and the command line, against plain versions on small fixtures."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace import cli
from kinetrace.drivers import prediction, training
from kinetrace.functions import geometry, vocabulary
from kinetrace.models import boosting
from kinetrace.operators import evaluation, intervals, metrics, reports, splits, timeline
from kinetrace.sources import legacy, recordings


def test_resample_rules_against_interp(spark):
    """Jittered runs against numpy: short runs go, grids start and end inside, numbering is dense."""
    r = np.random.default_rng(3)
    rows, want, at, t = [], [], 0, 3
    for n in (300, 255, 100, 260, 256):
        ms = t + np.cumsum(r.integers(15, 26, n))
        v = r.integers(-500, 500, (n, 2))
        rows += [("k", len(rows) + i, int(a), *map(int, x)) for i, (a, x) in enumerate(zip(ms, v, strict=True))]
        first, last = -(-ms[0] // 20) * 20, ms[-1] // 20 * 20
        if n >= 256 and last - first >= 255 * 20:
            grid = np.arange(first, last + 1, 20)
            want.append((grid, [np.rint(np.interp(grid, ms, v[:, k])) for k in range(2)]))
        t = int(ms[-1]) + 500
    d = spark.createDataFrame(rows, "key string, i long, ms long, a long, b long").repartition(4)
    signal, segments = timeline.resample_session(d, ["key"], "i", "ms", ["a", "b"])
    got = signal.orderBy("frame_index").collect()
    for k, (grid, values) in enumerate(want):
        own = got[at : at + len(grid)]
        assert {g.segment_id for g in own} == {k} and [g.t_ms for g in own] == grid.tolist()
        assert [g.a for g in own] == values[0].tolist() and [g.b for g in own] == values[1].tolist()
        at += len(grid)
    assert at == len(got) and [g.frame_index for g in got] == list(range(at))
    assert [(s.segment_id, s.stop_index - s.start_index) for s in segments.orderBy("segment_id").collect()] == [(k, len(g)) for k, (g, _) in enumerate(want)]


def test_train_predict_and_sinks(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = []
    for cow in range(6):
        for i in range(120):
            x = float(r.normal())
            rows.append((f"k{cow}", f"cow{cow}", "d", f"s{cow}", 0, i * 25, i * 500, x, float(r.normal()), int(x > 0.2), *([int(x > 1.0)] + [0] * 6), *([1] * 7)))
    names = [*(f"event_{e}" for e in vocabulary.EVENTS), *(f"mask_{e}" for e in vocabulary.EVENTS)]
    kind = "cache_key string, cow_id string, device_mac string, session_id string, segment_id int, center_index long, center_time_ms long, f1 double, f2 double, body_target int, " + ", ".join(f"{c} int" for c in names)
    d = spark.createDataFrame(rows, kind)
    tasks, summary = training.train_tasks(d, features=["f1", "f2"], settings=boosting.Settings(trees=3, rate=0.5, depth=2, columns=1.0))
    assert [t.name for t in tasks] == [boosting.POSTURE, vocabulary.EVENTS[0]] and set(summary["skipped"]) == {"WALKING", *vocabulary.EVENTS[1:]}
    training.save_bundle(spark, tasks, summary, str(tmp_path / "bundle"))
    back, told = training.load_bundle(spark, str(tmp_path / "bundle"))
    assert told["thresholds"] == {t.name: t.threshold for t in back}
    dense, found = prediction.run(d, back, str(tmp_path / "run"), threshold=0.5)
    assert dense.count() == len(rows) and spark.read.parquet(str(tmp_path / "run/dense")).count() == len(rows)
    high = dense.filter(f"prob_{vocabulary.EVENTS[0]} >= 0.5").count()
    assert high > 20 and found.filter(F.col("event_code") != vocabulary.EVENTS[0]).count() == 0 < found.count()
    assert found.filter(F.col("max_prob") < 0.5).count() == 0
    assert dense.filter(F.abs(F.col("prob_posture_LYING") + F.col("prob_posture_UPRIGHT") - 1) > 1e-9).count() == 0
    own = back[0].score(d).select("cache_key", "center_index", F.col(f"prob_{boosting.POSTURE}").alias("p"))
    assert own.join(dense, ["cache_key", "center_index"]).filter(F.abs(F.col("p") - F.col("prob_posture_LYING")) < 1e-12).count() == len(rows)
    assert dense.filter("prob_posture_LYING > 0.6").count() > 100 < dense.filter("prob_posture_UPRIGHT > 0.6").count()
    alone = prediction.dense_scores(d, back[1:])[0].first()
    assert (alone.prob_posture_LYING, alone.prob_posture_UPRIGHT, alone.prob_WALKING) == (0.5, 0.5, 0.0)
    with pytest.raises(ValueError):
        prediction.dense_scores(d, back, 1.0)


def plain_report(points, merge_gap, least, tolerance=2500):
    """sessions: {(device, session): (truth, pred, hits)} by a loop over sessions."""

    def runs(ts):
        out = []
        for t in ts:
            if out and t - out[-1][1] + 500 <= 750:
                out[-1][1] = t + 500
            else:
                out.append([t, t + 500])
        return out

    counts = {}
    for key in sorted({p[:2] for p in points}):
        own = [p for p in points if p[:2] == key and p[4]]
        if not own:
            continue
        truth, pred = runs([p[3] for p in own if p[5]]), []
        for a, b in runs([p[3] for p in own if p[6] >= 0.5]):
            if pred and a - pred[-1][1] <= merge_gap:
                pred[-1][1] = b
            else:
                pred.append([a, b])
        pred = [x for x in pred if x[1] - x[0] >= least]
        pairs = sorted(((-(min(t[1] + tolerance, p[1]) - max(t[0] - tolerance, p[0])), -i, -j) for i, t in enumerate(truth) for j, p in enumerate(pred) if min(t[1] + tolerance, p[1]) > max(t[0] - tolerance, p[0])))
        seen_t, seen_p = set(), set()
        for _, i, j in pairs:
            if i not in seen_t and j not in seen_p:
                seen_t.add(i)
                seen_p.add(j)
        counts[key] = (len(truth), len(pred), len(seen_t))
    return counts


def test_event_report_against_loops(spark):
    r = np.random.default_rng(9)
    points = []
    for c in range(4):
        for s in range(2):
            on = False
            for i in range(300):
                on = on if r.random() > 0.08 else not on
                score = float(np.clip((0.7 if on else 0.3) + r.normal(0, 0.15), 0, 1))
                points.append((f"d{c}", f"s{s}", f"cow{c}", i * 500, int(r.random() < 0.95 and not (c == 3 and s == 1)), int(on), score))
    d = spark.createDataFrame(points, "device_mac string, session_id string, cow_id string, center_time_ms long, m int, y int, p double").repartition(5)
    sessions, cows, pooled = evaluation.event_report(d, "y", "m", "p", 0.5, 2000, 1000)
    want = plain_report(points, 2000, 1000)
    assert {(x.device_mac, x.session_id): (x.truth, x.pred, x.hits) for x in sessions.collect()} == want
    total, one = [sum(v[k] for v in want.values()) for k in range(3)], pooled.first()
    assert [one.truth, one.pred, one.hits] == total and one.animals == 4 and one.evidence_level == "reportable"
    assert one.precision == pytest.approx(total[2] / total[1]) and one.recall == pytest.approx(total[2] / total[0])
    assert 0 < one.f1_at_50 <= one.f1_at_10 <= 1 and one.onset_median is not None and 0 < one.edit_score <= 100
    of3 = [x for x in cows.collect() if x.cow_id == "cow3"][0]
    hours = sum(p[4] for p in points if p[2] == "cow3") * 0.5 / 3600
    assert of3.false_alarms_per_24h == pytest.approx((of3.pred - of3.hits) / hours * 24)
    quiet = d.withColumn("y", F.lit(0))
    assert evaluation.event_report(quiet, "y", "m", "p", 0.5, 2000, 1000)[2].first().scope == "trusted_negative_only"
    given = spark.createDataFrame([("d0", "s0", 1000, 4000), ("d9", "s0", 0, 500)], "device_mac string, session_id string, start_t long, end_t long")
    assert evaluation.event_report(d, "y", "m", "p", 0.5, 2000, 1000, annotations=given)[2].first().truth == 1


def test_augmentation_turns_whole_groups(spark):
    d = spark.createDataFrame([(g, i, *map(float, np.random.default_rng(10 * g + i).normal(size=3))) for g in range(3) for i in range(20)], "g int, i int, x double, y double, z double")
    got = geometry.augmented(d, ["g"], [["x", "y", "z"]], seed=4).orderBy("g", "i").collect()
    before = np.array([r[2:] for r in d.orderBy("g", "i").collect()])
    after = np.array([r[2:] if r[0] is not None else r for r in [tuple(g) for g in got]], float)
    for g in range(3):
        a, b = before[20 * g : 20 * g + 20], after[20 * g : 20 * g + 20]
        m, *_ = np.linalg.lstsq(a, b, rcond=None)
        k = np.linalg.norm(m[0])
        assert 0.97 <= k <= 1.03 and np.allclose(m @ m.T, k * k * np.eye(3), atol=1e-9) and np.linalg.det(m) > 0 and np.allclose(a @ m, b, atol=1e-9)
    angles = [F.lit(x) for x in (0.3, -0.2, 0.5)]
    m = np.array(spark.range(1).select(*[c for row in geometry.euler(*angles) for c in row]).first()).reshape(3, 3)
    (a, b, c) = (0.3, -0.2, 0.5)
    rz, ry, rx = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]), np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]]), np.array([[1, 0, 0], [0, np.cos(c), -np.sin(c)], [0, np.sin(c), np.cos(c)]])
    assert np.allclose(m, rz @ ry @ rx)


def test_small_operators(spark):
    runs = spark.createDataFrame([("a", 2500)], "k string, n long")
    chunks = timeline.chunk_index(runs, ["k"], "n")
    rows = spark.createDataFrame([("a", 1190), ("a", 2400)], "k string, i long")
    assert [r.chunk for r in timeline.supervised_chunks(chunks, rows, ["k"], "i", F.lit(True)).orderBy("chunk").collect()] == [0, 1, 2]
    assert [r.chunk for r in timeline.supervised_chunks(chunks, rows.filter("i > 2000"), ["k"], "i", F.lit(True)).collect()] == [2]
    values = spark.createDataFrame([(i, float(i * i)) for i in range(9)], "entity int, v double")
    got = metrics.bootstrap(values, "v", statistic="median").first()
    assert got.point == 16.0 and got.low <= 16 <= got.high
    with pytest.raises(ValueError):
        splits.fold_rows(values, spark.createDataFrame([(1, 3, "test")], "fold int, entity int, role string"), 1, "train", "entity")
    assert legacy.channels(spark.createDataFrame([(0,) * 10], ", ".join(["k int", *(f"{c} int" for c in recordings.RAW_CHANNELS)])), "accgyro6").columns == ["k", *recordings.RAW_CHANNELS[:6]]
    assert vocabulary.names_table(spark).count() == len(vocabulary.STATES) + len(vocabulary.EVENTS) + len(vocabulary.DEPRECATED)
    points, bounds = spark.createDataFrame([(5,), (50,)], "t long").withColumn("k", F.lit(1)), spark.createDataFrame([(1, 0, 10)], "k int, lo long, hi long")
    with pytest.raises(Exception, match="outside"):
        intervals.owning_segment(points, bounds, ["k"], "t", "lo", "hi", 100, strict=True).collect()


def test_data_checks(spark):
    a = spark.createDataFrame([("e1", "URINATION", 0, 5, "c", "s"), ("e1", "NONSENSE", 7, 7, "c", "s")], "event_id string, code string, t_start_rel_ms long, t_end_rel_ms long, cow_id string, session_id string")
    sessions, caches = (spark.createDataFrame([(k,) for k in ks], "cache_key string") for ks in (("a", "b"), ("b", "c", "c")))
    folds = spark.createDataFrame([(1, "x", "train"), (1, "x", "test"), (1, "y", "train")], "fold int, cow_id string, role string")
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "f double")
    got = {r.check: (r.n, r.verdict) for r in reports.data_checks(a, vocabulary.EVENTS, sessions, caches, folds, numbers).collect()}
    assert got == {"missing_columns": (0, "FAIL"), "duplicate_event_id": (1, "FAIL"), "empty_interval": (1, "FAIL"), "unknown_code": (1, "FAIL"), "sessions_without_cache": (2, "FAIL"), "leak_between_roles": (1, "FAIL"), "not_finite": (2, "FAIL")}
    clean = reports.data_checks(a.limit(1).drop("cow_id"), vocabulary.EVENTS).collect()
    assert {r.check: r.n for r in clean}["missing_columns"] == 1


def test_command_line_from_recordings_to_intervals(spark, tmp_path, monkeypatch, capsys):
    """build-cache, build-features, train-gbdt and predict after each other, on recordings made here."""
    monkeypatch.setattr(cli, "build", lambda master: spark)
    r, raw = np.random.default_rng(2), tmp_path / "raw"
    raw.mkdir()
    for k in range(4):
        n = 3000
        f = np.zeros(n, recordings.FRAME)
        f["ms"] = np.arange(n) * 20
        f["v"] = r.integers(-50, 50, (n, 9)) + np.array([0, 0, 4096, 0, 0, 0, 0, 0, 0]) + np.where((np.arange(n) // 500) % 2, 700, 0)[:, None]
        (raw / f"s{k}.json").write_text(json.dumps({"imu": base64.b64encode(f.tobytes()).decode(), "device": f"d{k}", "create_time": 0}))
    marks = [(f"e{k}{i}", f"s{k}", f"cow{k}", f"d{k}", ("LYING", "STANDING")[i % 2], i * 10_000, (i + 1) * 10_000) for k in range(4) for i in range(6)]
    spark.createDataFrame(marks, "event_id string, session_id string, cow_id string, device_mac string, code string, t_start_rel_ms long, t_end_rel_ms long").write.parquet(str(tmp_path / "marks"))
    spark.createDataFrame([(f"s{k}", True) for k in range(5)], "session_id string, eligible boolean").write.parquet(str(tmp_path / "calibration"))
    at = lambda name: str(tmp_path / name)
    assert cli.main(["build-cache", at("raw"), at("marks"), at("calibration"), at("cache")]) == 0
    assert json.loads(capsys.readouterr().out)["included_sessions"] == 4
    signal = spark.read.parquet(at("cache/signal")).withColumnRenamed("quality", "quality")
    assert signal.count() == 4 * 3000
    signal.write.parquet(at("signal"))
    assert cli.main(["build-features", at("signal"), at("features")]) == 0
    assert cli.main(["train-gbdt", at("features"), at("cache/dense"), at("bundle"), "--trees", "2"]) == 0
    assert boosting.POSTURE in json.loads(capsys.readouterr().out)["trained"]
    assert cli.main(["predict", at("signal"), at("bundle"), at("run"), "--causal"]) == 0
    assert spark.read.parquet(at("run/dense")).count() == 4 * 120
    assert cli.main(["check-data", at("marks")]) == 0 and cli.main(["train"]) == 2
    assert cli.main(["diagnose", at("marks"), "--out", at("report")]) == 0
    assert "LYING" in spark.read.text(at("report/diagnostics")).first()[0]


def test_diagnostics_and_candidate_columns(spark):
    marks = spark.createDataFrame([("URINATION", f"c{i % 3}", f"s{i}", 0, 1000 * (i + 1)) for i in range(12)] + [("LYING", "c0", "s0", 0, 500)], "code string, cow_id string, session_id string, t_start_rel_ms long, t_end_rel_ms long")
    bounds = spark.createDataFrame([("k1", 0, 500), ("k1", 600, 700), ("k2", 0, 50)], "cache_key string, start_index long, stop_index long")
    reviews = spark.createDataFrame([("s1", "URINATION", 1, 0, 7_200_000), ("s2", "URINATION", 0, 0, 999), ("s2", "MOUNTING", 0, 0, 5)], "session_id string, event_code string, exhaustive_reviewed int, t_start_rel_ms long, t_end_rel_ms long")
    cows = spark.createDataFrame([(1, "c0", "test"), (1, "c1", "train"), (1, "c2", "validation")], "fold long, cow_id string, role string")
    got = {k: [r.asDict() for r in t.collect()] for k, t in reports.diagnostics(marks, vocabulary.events_table(spark), bounds, reviews, cows).items()}
    audit = {r["code"]: r for r in got["annotations"]}
    assert (audit["URINATION"]["median_s"], audit["URINATION"]["animals"], audit["LYING"]["annotations"]) == (6.5, 3, 1)
    able = {r["code"]: r["evaluable"] for r in got["evaluability"]}
    assert able["URINATION"] and not able["MOUNTING"] and set(able) == {*vocabulary.EVENTS, *vocabulary.DEPRECATED}
    assert (got["segments"][0]["segments"], got["segments"][0]["median_s"]) == (3, 2.0) and {(r["segments"], r["sessions"]) for r in got["segments per session"]} == {(1, 1), (2, 1)}
    assert got["coverage"] == [{"event_code": "URINATION", "reviewed_hours": 2.0, "sessions": 1, "verdict": "claimable"}]
    assert (got["folds"][0]["test_samples"], got["folds"][0]["usable"]) == (5, False) and got["balance"][0]["animals"] == 3
    assert set(reports.diagnostics(marks, vocabulary.events_table(spark))) == {"annotations", "evaluability", "balance"}
    dense = spark.createDataFrame([("k", "c", "d", "s", i * 500, 0.9 if 4 <= i < 20 else 0.1) for i in range(40)], "cache_key string, cow_id string, device_mac string, session_id string, center_time_ms long, prob_URINATION double")
    one = prediction.candidates(dense, {"URINATION": 0.7}, ("URINATION",)).collect()
    assert [(x.label, x.threshold, x.start_t, x.end_t, x.max_prob) for x in one] == [("urination", 0.7, 2000, 10000, 0.9)]
