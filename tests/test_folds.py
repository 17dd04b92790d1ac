"""Fold runs: boosted tasks end to end, a fold that fails alone, sinks, predictions onto rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.drivers import folds
from kinetrace.functions import vocabulary
from kinetrace.models import boosting
from kinetrace.operators import metrics, splits
from kinetrace.plans import drivers
from kinetrace.plans import folds as _plans  # noqa: F401  (registers fold_events)
from kinetrace.plans.catalog import QUERIES

from .test_entry import SF


@pytest.fixture(scope="module")
def rows(spark):
    r, out = np.random.default_rng(5), []
    for cow in range(6):
        for i in range(150):
            x = float(np.sin(i / 6) + r.normal(0, 0.2))
            out.append((f"k{cow}", f"cow{cow}", "d", f"s{cow}", i * 25, i * 500, x, int(x > 0.2), *([int(x > 0.8)] + [0] * 6), *([1] * 7)))
    names = [*(f"event_{e}" for e in vocabulary.EVENTS), *(f"mask_{e}" for e in vocabulary.EVENTS)]
    return spark.createDataFrame(out, "cache_key string, cow_id string, device_mac string, session_id string, center_index long, center_time_ms long, f1 double, body_target int, " + ", ".join(f"{c} int" for c in names))


def test_boosted_folds(spark, rows, tmp_path):
    cows = splits.grouped_folds(rows, "cow_id", 3)
    bad = cows.unionByName(spark.createDataFrame([(9, "cow0", "test"), (9, "cow1", "train")], "fold long, cow_id string, role string"))
    run = folds.run_folds(rows, bad, folds.boosted(["f1"], boosting.Settings(trees=2, rate=0.5, depth=2, columns=1.0)))
    s = {x.fold: x for x in run.summary.collect()}
    assert {k: v.status for k, v in s.items()} == {1: "complete", 2: "complete", 3: "complete", 9: "failed"} and "validation" in s[9].error
    tested = {(x.fold, x.cow_id) for x in run.scored.select("fold", "cow_id").distinct().collect()}
    assert tested == {(x.fold, x.cow_id) for x in cows.filter("role = 'test'").collect()} and run.scored.count() == rows.count()
    assert all(s[k].posture_macro_f1 > 0.9 and 0.8 < s[k].event_ap <= 1 and s[k].walking_ap is None for k in (1, 2, 3))
    own = [x for x in run.events.collect() if x.event_code == vocabulary.EVENTS[0]]
    assert len(own) == 3 and all(0 < x.hits <= x.truth for x in own)
    run.write(str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/predictions")).filter("fold = 2").count() == 300
    told = json.loads(spark.read.text(str(tmp_path / "run/overall")).first()[0])
    assert (told["complete"], told["failed"]) == (3, 1) and told["least_score"] <= told["mean_score"] <= told["most_score"]
    with pytest.raises(ValueError, match="every fold failed"):
        folds.run_folds(rows, bad.filter("fold = 9"))


@pytest.mark.parametrize("where", ["fit", "worker"])
def test_an_error_is_no_result(spark, rows, where):
    """A fold that the code or a worker fails in ends the run; one whose animals allow no task is a row of the summary."""
    cows = splits.grouped_folds(rows, "cow_id", 3)
    first = {r.cow_id for r in cows.filter("fold = 1 AND role = 'train'").collect()}

    def fit(train, validation, why=RuntimeError):
        broken = {r.cow_id for r in train.select("cow_id").distinct().collect()} == first
        if broken and (where == "fit" or why is folds.Unfit):
            raise why("lost")
        return [drivers.Ratio(boosting.POSTURE, F.raise_error(F.lit("lost")).cast("double") if broken else F.col("f1"), 0.5)]

    with pytest.raises(Exception, match="lost"):
        folds.run_folds(rows, cows, fit)
    run = folds.run_folds(rows, cows, lambda train, validation: fit(train, validation, folds.Unfit))
    lost = {r.cow_id for r in cows.filter("fold = 1 AND role = 'test'").collect()}
    assert [tuple(r) for r in run.failed.collect()] == [(1, "Unfit: lost")] and not lost & {r.cow_id for r in run.scored.select("cow_id").distinct().collect()}


def test_fold_events_does_not_leave_out_a_failed_fold(spark, monkeypatch):
    choose, asked = metrics.choose_threshold, []

    def broken(*args, **more):
        asked.append(1)
        return choose(*args, **more) if len(asked) != 2 else spark.range(1).select(F.raise_error(F.lit("lost")))

    monkeypatch.setattr(metrics, "choose_threshold", broken)
    with pytest.raises(Exception, match="lost"):
        QUERIES["fold_events"](spark, SF)


def test_predictions_onto_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, i int")
    found = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], "k string, i int, p double")
    assert {(x.k, x.i): x.p for x in splits.onto_rows(rows, found, ["k", "i"]).collect()} == {("a", 1): 0.5, ("a", 2): None, ("b", 1): 0.7}
    with pytest.raises(Exception, match="twice"):
        splits.onto_rows(rows, found.union(found), ["k", "i"]).collect()
