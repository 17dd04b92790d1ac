"""What the third review found: each test failed before its finding was mended."""

import hashlib
import statistics

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetrace.models import boosting, trees
from kinetrace.operators import features, metrics, prefix, splits
from kinetrace.plans import drivers, folds, learning  # noqa: F401
from kinetrace.plans.catalog import QUERIES, SQL
from kinetrace.sources import recordings
from kinetrace.streaming import causal

from .test_entry import SF, duck, plain  # noqa: F401
from .test_trees import FIXED, sample


def equals_sql(spark, duck, name, sf=SF):  # noqa: F811
    got = QUERIES[name](spark, sf)
    order = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(order)} FROM ({SQL[name]})").fetchall()
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(got.select(*order).collect()) == key(want)


def test_tasks_without_a_forest_score_themselves(spark):
    d = spark.createDataFrame([(0.2,), (0.9,)], "x double")
    got = boosting.predict(d, [drivers.Ratio("A", F.col("x") / 2, 0.4), boosting.Task("B", ["x"], boosting.Forest(["x"]), 0.5, "default")]).collect()
    assert [(r.prob_A, r.prob_B, r.threshold_A, r.prob_posture_LYING) for r in got] == [(0.1, 0.5, 0.4, 0.5), (0.45, 0.5, 0.4, 0.5)]


def test_predicted_scores_equal_sql(spark, duck):  # noqa: F811
    equals_sql(spark, duck, "predicted_scores")


def test_fold_runs_equal_sql(spark, duck):  # noqa: F811
    equals_sql(spark, duck, "fold_runs")


def test_fold_events_equal_sql(spark, duck):  # noqa: F811
    equals_sql(spark, duck, "fold_events")


def test_animals_of_folds_are_numbered_over_tasks(spark, monkeypatch):
    """No task gets all animals; the roles are those of one sorted list."""
    seen, cut = {}, prefix.written
    monkeypatch.setattr(prefix, "written", lambda d, name: seen.setdefault(f"{name}-{len(seen)}", cut(d, name)))
    n, seed = 1001, 20260819
    d = splits.grouped_folds(spark.range(n).withColumnRenamed("id", "cow"), "cow", 4)
    assert "SinglePartition" not in d._jdf.queryExecution().executedPlan().toString()
    dealt = [t.groupBy("_range").count().collect() for name, t in seen.items() if name.startswith("prefix-rows")]
    assert [sum(r["count"] for r in t) for t in dealt] == [n, 3 * n] and all(max(r["count"] for r in t) < sum(r["count"] for r in t) / 2 for t in dealt)
    order = sorted(range(n), key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
    sizes, want, at = [251, 250, 250, 250], set(), 0
    for fold, size in enumerate(sizes, 1):
        test, at = set(order[at : at + size]), at + size
        rest = [c for c in range(n) if c not in test]
        held = round(len(rest) * 0.2)
        want |= {(fold, c, "test") for c in test} | {(fold, c, "validation" if i < held else "train") for i, c in enumerate(rest)}
    got = [tuple(r) for r in d.collect()]
    assert len(got) == 4 * n and set(got) == want


@pytest.mark.parametrize("positives", [False, True])
def test_folds_of_one_class_equal_sql(spark, tmp_path, positives):
    """Validation rows (users 0 to 3) of one class; of the test rows those of one fold are all walking and have no event."""
    first = set(sorted(range(20), key=lambda c: (hashlib.md5(f"20260819:{c}".encode()).hexdigest(), c))[:5])
    rows = []
    for u in range(20):
        for j in range(30):
            one = positives and u < 4
            score = 0.1 + 0.01 * j if u in first or u < 4 and not positives else 0.62 + 0.01 * j if one else 0.3 + 0.02 * j
            rows.append(((u * 30 + j) * 4 + (1 if one or j % 3 else 4), j, u, "click" if u in first or j % 5 == 0 else "view", 35 * score / (1 - score)))
    c = duckdb.connect()
    c.execute("CREATE TABLE raw (event_id BIGINT, j INT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    c.executemany("INSERT INTO raw VALUES (?, ?, ?, ?, ?)", rows)
    c.execute("CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * j AS ts, * EXCLUDE (event_id, j) FROM raw")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    equals_sql(spark, c, "fold_runs", str(tmp_path))


def below(plan, node):
    """The subtrees of a printed plan under each such node."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*|"))
    for i, line in enumerate(lines):
        if node in line:
            n = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i + 1 : n]))
    return out


def values(spark, n):
    return spark.range(n).select(F.col("id").alias("entity"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))


def test_bootstrap_does_not_broadcast_its_draws(spark):
    plan = metrics.bootstrap(values(spark, 3000), "v")._jdf.queryExecution().executedPlan().toString()
    built = below(plan, "BroadcastExchange")
    assert built and not any("conv(" in side and "HashAggregate" not in side for side in built)


def test_bootstrap_medians_are_exact(spark):
    """Draws outside the counted middle are made up for; without any middle all are."""
    n, seed = 201, 7
    rows = values(spark, n)
    v = [r.v for r in rows.orderBy("entity").collect()]
    place = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (v[i], i)))}
    d = spark.createDataFrame([(i, v[i], place[i]) for i in range(n)], "i long, v double, q long")
    for size in (n, n - 1):
        own = d.filter(F.col("i") < size)
        own = own.withColumn("q", F.row_number().over(Window.orderBy("q")).cast("long") - 1)
        want = {r: statistics.median(v[int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:12], 16) % size] for j in range(size)) for r in range(20)}
        for reach in (0, 3, size):
            got = {x.r: x.m for x in metrics.resampled_medians(own, spark.range(20).withColumnRenamed("id", "r"), size, seed, reach).collect()}
            assert got == pytest.approx(want)


def test_bootstrap_looks_draws_up_where_they_are_made(spark):
    """600,001 groups make 600 million draws, which must not meet the groups in a shuffle; only blocks of the groups travel."""
    plan = metrics.bootstrap(values(spark, 600_001), "v")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and any("collect_list" in side for side in below(plan, "BroadcastExchange"))


def test_bootstrap_is_the_same_by_blocks_and_by_shuffle(spark, monkeypatch):
    d, got = values(spark, 500), []
    for name, size in (("BLOCK", 1 << 12), ("BLOCK", 7), ("MOST_GROUPS", 499)):
        monkeypatch.setattr(metrics, name, size)
        got.append([v for kind in ("mean", "median") for v in metrics.bootstrap(d, "v", 50, statistic=kind).first()])
    assert got[1] == pytest.approx(got[0], abs=1e-12) and got[2] == pytest.approx(got[0], abs=1e-12)


def test_micro_batches_do_not_grow_with_the_entities(spark, monkeypatch):
    """Four tasks of 50 rows each take 200 of 480 rows: three slices. One entity of 120 rows asks as many; a slice may be empty."""
    monkeypatch.setattr(learning, "SLICE", 50)
    rows = [(e, 1000 * t + e, float(e + t)) for e in range(40) for t in range(9)] + [(99, 1000 * t, 1.0) for t in range(120)]
    d, asked = spark.createDataFrame(rows, "entity long, t long, score double"), []

    def plan(stream):
        asked.append(1)
        return causal.sliding_mean(stream, "entity", "t", "score", 4)

    got = learning.replay(spark, d, "slices", plan, ["entity"], "t").collect()
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(-3, 0)
    want = d.select("entity", "t", F.avg("score").over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("points")).collect()
    assert len(asked) <= 3 and sorted((r.entity, r.t, round(r.mean, 9), r.points) for r in got) == sorted((r.entity, r.t, round(r.mean, 9), r.points) for r in want)
    assert learning.replay(spark, d.filter("t < 0"), "slices", plan, ["entity"], "t").count() == 0


def test_more_entities_are_more_tasks_of_one_micro_batch(spark, monkeypatch):
    """480 small entities ask 20 tasks of 72 rows, not slices in which Python is called for each entity again; the session's settings come back."""
    monkeypatch.setattr(learning, "SLICE", 72)
    rows = [(e, 1000 * t + e, float(e + t)) for e in range(480) for t in range(3)]
    held = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"]
    d, asked, had = spark.createDataFrame(rows, "entity long, t long, score double"), [], [spark.conf.get(k) for k in held]

    def plan(stream):
        asked.append([spark.conf.get(k) for k in held])
        return causal.sliding_mean(stream, "entity", "t", "score", 2)

    got = learning.replay(spark, d, "tasks", plan, ["entity"], "t").collect()
    assert [(n, kind.rsplit(".")[-1]) for n, kind in asked] == [("20", "RocksDBStateStoreProvider")] and [spark.conf.get(k) for k in held] == had
    assert sorted((r.entity, r.t, r.points) for r in got) == [(e, t, min(i, 1) + 1) for e in range(480) for i, t in enumerate(1000 * t + e for t in range(3))]


def test_references_take_several_sessions_at_once(spark, monkeypatch):
    """Bundles of any size give the same references; null keys are keys of their own."""
    r = np.random.default_rng(4)
    rows = [(k, s, i, *map(float, r.normal(size=6)), 0) for k, s, n in (("a", 0, 700), ("a", 1, 90), ("b", 0, 33), ("d", 5, 200), ("c", 0, 20)) for i in range(n)]
    names = ", ".join(f"{c} double" for c in features.CHANNELS)
    d, got = spark.createDataFrame(rows, f"cache_key string, segment_id int, frame_index long, {names}, quality int"), []
    for size in (1, 150, 1 << 20):
        monkeypatch.setattr(features, "BUNDLE", size)
        got.append(sorted(map(str, features.references(d, "cache_key", "segment_id", "frame_index", True).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 3
    table = pa.table({"k": ["y", None, "x", "y", None], "n": [2, 1, 1, 2, 1], "at": [9, 3, 0, 4, 1]})
    order, found = features.parts(table, ["k", "n"], "at")
    assert [order[one].tolist() for one in found] in ([[3, 0], [4, 1], [2]], [[2], [3, 0], [4, 1]], [[4, 1], [2], [3, 0]], [[4, 1], [3, 0], [2]], [[2], [4, 1], [3, 0]], [[3, 0], [2], [4, 1]])


def test_samples_of_a_segment_reach_the_state_as_one_row(spark, tmp_path):
    """The plan of the streamed bank has one Python pass that packs rows before the shuffle and the join with the references."""
    r = np.random.default_rng(6)
    rows = [("a", 0, i, *map(float, r.normal(size=6)), 0) for i in range(200)]
    schema = "cache_key string, segment_id int, frame_index long, " + ", ".join(f"{c} double" for c in features.CHANNELS) + ", quality int"
    d = spark.createDataFrame(rows, schema)
    d.write.parquet(str(tmp_path / "in"))
    known = features.references(d, "cache_key", "segment_id", "frame_index", True)
    plan = causal.feature_bank(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), known)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "MapInArrow" in plan.split("Join", 1)[1]


def test_recordings_are_decoded_once(spark):
    """Both tables from one written pass equal those of a pass each."""
    frame = recordings.packed(F.col("id") * 20, [F.col("id") % 7] * 9)
    body = spark.range(400).select((F.col("id") % 2).alias("k"), "id", frame.alias("f")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("s"))
    raw = body.select("k", recordings.joined(F.col("s.f")).alias("payload")).unionByName(spark.createDataFrame([(7, bytearray(100)), (8, None)], "k long, payload binary"))
    assert {r.k: len(r.payload) for r in raw.filter("k < 2").collect()} == {0: 4400, 1: 4400}
    for once, twice in zip(recordings.decode_frames(raw, "k", once=True), recordings.decode_frames(raw, "k"), strict=True):
        assert once.schema == twice.schema and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_windows_of_a_block_are_found_once(monkeypatch):
    asked, rows = [], features.window_rows
    monkeypatch.setattr(features, "window_rows", lambda c, n, lo, hi: asked.append((lo, hi)) or rows(c, n, lo, hi))
    block = np.random.default_rng(1).normal(size=(700, 6))
    features.bank(block, np.zeros(700), np.arange(0, 700, 25), True, np.array([0, 0, 1.0]), 5.0, 2)
    assert len(asked) == len(set(asked)) <= len(features.SCALES) + 2 * len(features.TRANSITIONS)


def test_boosting_rows_lie_in_blocks(spark, monkeypatch):
    """A block per partition for 500 rows of 29 bytes; blocks of seven rows, added up three at a time, give the same trees."""
    _, _, _, d = sample(spark)
    names, own = ["f0", "f1", "f2"], FIXED | {"subsample": 0.7}
    assert trees.binned(d, names, ["a", "b"], [[3.0, 6.0]] * 3).count() == 5
    whole = trees.fit_forests(d, names, ["a", "b"], [2.0, 3.0], trees=3, **own)
    for name, value in (("BLOCK", 7 * 29), ("STEP", 21), ("REFRESH", 2)):
        monkeypatch.setattr(trees, name, value)
    assert trees.binned(d, names, ["a", "b"], [[3.0, 6.0]] * 3).count() == 75
    assert whole == trees.fit_forests(d, names, ["a", "b"], [2.0, 3.0], trees=3, **own)


def test_rows_end_where_single_steps_lead():
    """Trees of no split, of one and of uneven depth."""
    r = np.random.default_rng(5)
    x = r.integers(0, 256, (300, 3)).astype("u1")
    for feature in ([-1] * 15, [1] + [-1] * 14, [0, 2, -1, -1, 1] + [-1] * 10):
        tree = trees.Tree.empty(3)
        tree.feature, tree.bin = feature, r.integers(0, 256, 15).tolist()

        def walk(row, i=0, tree=tree):
            f = tree.feature[i]
            return i if f < 0 else walk(row, 2 * i + 1 + (int(row[f]) > tree.bin[i]))

        assert tree.nodes(x, tree.bin).tolist() == [walk(row) for row in x]
