"""Streams against their batch forms: rows in any order within the lateness, segments cut into micro-batches."""

import numpy as np
import pytest

from kinetrace.operators import features, posture
from kinetrace.streaming import causal

from .test_features import KIND, motion


def replayed(spark, tmp_path, parts, schema, plan):
    """Each part is a micro-batch of its own; what the stream gave out."""
    (tmp_path / "in").mkdir()
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = plan(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def late_parts(rows, lateness, seed=5):
    """Rows in order of arrival, which lies up to the lateness behind their time, in four parts; a far row at the end moves the mark."""
    r = np.random.default_rng(seed)
    came = sorted(rows, key=lambda x: x[1] + r.uniform(0, lateness))
    cut = len(came) // 4
    return [came[:cut], came[cut : 2 * cut], came[2 * cut : 3 * cut], came[3 * cut :]]


def test_ordered_runs_equal_the_batch(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(e, 1_000_000 + 1000 * i + e, float(r.random() < 0.4)) for e in range(3) for i in range(160) if r.random() < 0.9]
    parts = [*late_parts(rows, 20_000), [(99, 9_000_000, 0.0)]]
    got = replayed(spark, tmp_path, parts, "entity long, t long, score double", lambda s: causal.ordered_runs(s, "entity", "t", "score", 0.5, 2000, 1000, "30 seconds"))
    want = []
    for e in range(3):
        open_, last = None, None
        for t in sorted(t for k, t, v in rows if k == e and v >= 0.5):
            if open_ is not None and t - last > 2000:
                want.append((e, open_, last + 1000))
                open_ = None
            open_, last = (t if open_ is None else open_), t
        want.append((e, open_, last + 1000))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ordered_machine_equals_the_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(e, 1_000_000 + 500 * i + (40_000 if i > 60 else 0), *map(float, r.random(4))) for e in range(2) for i in range(120)]
    schema = "entity long, t long, upright double, lying double, up double, down double"
    machine = posture.Machine(2, 2, 0.1, 0.5, 750)
    parts = [*late_parts(rows, 5_000), [(99, 9_000_000, 0.0, 0.0, 0.0, 0.0)]]
    got = replayed(spark, tmp_path, parts, schema, lambda s: causal.ordered_state_machine(s, "entity", "t", "20 seconds", machine))
    want = posture.smooth(spark.createDataFrame(rows, schema), ["entity"], "t", machine).select("entity", "t", "state_sm")
    assert sorted(map(tuple, got.filter("entity < 99").collect())) == sorted(map(tuple, want.collect()))


def test_streamed_features_equal_the_batch(spark, tmp_path):
    """Micro-batches of uneven lengths, one under 64 rows at first, one between two decision points; a short segment gives nothing."""
    segments = [motion(9_000), motion(700, 2), motion(40, 3)]
    rows = [("a", s, i, *map(float, v), i % 2) for s, block in enumerate(segments) for i, v in enumerate(block)]
    cuts = [0, 30, 310, 315, 4_000, 9_000]
    parts = [[x for x in rows if lo <= x[2] < hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
    whole = spark.createDataFrame(rows, KIND)
    known = features.references(whole, "cache_key", "segment_id", "frame_index", True)
    got = replayed(spark, tmp_path, parts, KIND, lambda s: causal.feature_bank(s, known)).toPandas().sort_values(["segment_id", "center_index"])
    want = features.build(whole).filter("segment_id < 2").toPandas().sort_values(["segment_id", "center_index"])
    assert list(got.center_index) == list(want.center_index)
    for k in features.names(2)[:-2]:
        assert got[k].to_numpy() == pytest.approx(want[k].to_numpy(), rel=1e-6, abs=1e-6), k
