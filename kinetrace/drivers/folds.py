"""Fold runs of the boosted tasks: train, score and report every fold, side by side or one failing alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENTS, MERGE_GAP_MS, MIN_LENGTH_MS
from ..models.boosting import POSTURE, Settings, Task
from ..operators import evaluation, metrics, splits
from ..operators.prefix import join_groups
from ..sources import sinks
from ..sources.scratch import written
from .prediction import SESSION, dense_scores
from .training import train_tasks

#: Of a fold's animals: what trains, and what chooses thresholds.
Fit = Callable[[DataFrame, DataFrame], list[Task]]
KEYS = [*SESSION, "center_index"]
ROLES = ("train", "validation", "test")


class Unfit(ValueError):
    """A fold's animals do not allow its run: a row of the summary, where any other error ends the run."""


@dataclass
class FoldRun:
    """Scored test rows of all folds and what failed; metrics are computed for all folds at once when they are asked for."""

    scored: DataFrame
    failed: DataFrame
    tolerance: int = 2500

    @cached_property
    def long(self) -> DataFrame:
        return written(by_event(self.scored).filter("m = 1"), "fold-points")

    @cached_property
    def points(self) -> DataFrame:
        """Masked frame metrics per fold and event at the fold's threshold."""
        return written(metrics.binary_points(self.long, ["fold", "event_code"], "y", "p", F.lit(1.0)), "fold-metrics")

    @cached_property
    def events(self) -> DataFrame:
        """Interval metrics per fold and event."""
        return written(event_metrics(self.long, self.tolerance), "fold-events")

    @cached_property
    def summary(self) -> DataFrame:
        """One row per fold, failed ones with their reason."""
        return written(summary(self.scored, self.points, self.failed), "fold-summary")

    def write(self, path: str) -> None:
        """Predictions in one folder per fold, the other tables as CSV, the means over folds as JSON."""
        self.scored.write.mode("error").partitionBy("fold").parquet(f"{path}/predictions")
        for name in ("points", "events", "summary"):
            sinks.write_table(getattr(self, name), f"{path}/{name}", format="csv")
        sinks.write_json(self.summary.sparkSession, overall(self.summary).first().asDict(), f"{path}/overall")


def boosted(features: list[str] | None = None, settings: Settings = Settings()) -> Fit:
    """The nine boosted tasks, fitted on a fold's training animals, with thresholds of its validation animals."""
    return lambda train, validation: train_tasks(train.unionByName(validation), features=features, settings=settings, held=validation.select("cow_id"))[0]


def run_folds(rows: DataFrame, folds: DataFrame, fit: Fit | None = None, tolerance: int = 2500) -> FoldRun:
    """Every fold's run over ``rows`` (SESSION, center_index, center_time_ms, features, body_target, event_*, mask_*).

    ``folds`` has fold, cow_id, role (train, validation, test). A fold without animals of a role, or without evidence
    for any task (``fit`` may raise ``Unfit`` too), is a summary row with its reason; what fails otherwise, in a worker or
    in the code, raises, so that no result lacks a fold by it. Test rows are scored by their fold's tasks only and written; all metrics are
    then computed for all folds at once, so that their number adds no passes.
    """
    fit = fit or boosted()
    done, failed, folds = [], [], written(folds.select("fold", "cow_id", "role"), "fold-cows")
    there = {tuple(r) for r in folds.select("fold", "role").distinct().collect()}  # three roles a fold
    for k in sorted({fold for fold, _ in there}):
        try:
            if lost := [role for role in ROLES if (k, role) not in there]:
                raise Unfit(f"fold {k} has no {' or '.join(lost)} animals")
            train, validation, test = (rows.join(folds.filter((F.col("fold") == k) & (F.col("role") == role)).select("cow_id"), "cow_id", "left_semi") for role in ROLES)
            tasks = fit(train, validation)
            if not tasks:
                raise Unfit("no task has evidence enough")
            scores, limits = dense_scores(test, tasks)
            kept = test.select(*KEYS, "center_time_ms", "body_target", *[f"{p}_{e}" for e in EVENTS for p in ("event", "mask")])
            scored = splits.onto_rows(kept, scores.drop("center_time_ms"), KEYS).withColumn("fold", F.lit(k).cast("long"))
            done.append(written(scored.withColumns({f"threshold_{e}": F.lit(float(v)) for e, v in limits.items()}), f"fold-{k}"))
        except Unfit as e:  # a fold that can't be run stops no other
            failed.append((int(k), f"{type(e).__name__}: {e}"[:300]))
    spark = rows.sparkSession
    bad = spark.createDataFrame(failed, "fold long, error string")
    if not done:
        raise ValueError(f"every fold failed: {failed}")
    return FoldRun(reduce(DataFrame.unionByName, done), bad, tolerance)


def by_event(scored: DataFrame) -> DataFrame:
    """One row per test point and event: KEYS, fold, event_code, t, y, m, p (in units of the threshold), score."""
    parts = [F.struct(F.lit(e).alias("event_code"), F.col(f"event_{e}").alias("y"), F.col(f"mask_{e}").alias("m"), F.col(f"prob_{e}").alias("score"), (F.col(f"prob_{e}") / F.col(f"threshold_{e}")).alias("p")) for e in EVENTS]
    return scored.select("fold", *KEYS, F.col("center_time_ms").alias("t"), F.explode(F.array(*parts)).alias("x")).select("fold", *KEYS, "t", "x.*")


def code_value(table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for e in EVENTS for v in (e, table.get(e, 0))]), F.col("event_code"))


def event_metrics(long: DataFrame, tolerance: int) -> DataFrame:
    """Interval metrics per fold and event: truth, pred, hits within the tolerance and at each IoU, precision, recall, F1, false alarms per hour."""
    sessions, _ = evaluation.session_report(long, "y", "m", "p", 1.0, code_value(MERGE_GAP_MS), code_value(MIN_LENGTH_MS), ("fold", "event_code", "device_mac", "session_id"), "cow_id", "t", tolerance=tolerance)
    counts = ["points", "negatives", "hours", "truth", "pred", "hits", *[f"hits_{round(x * 100)}" for x in evaluation.TIOUS]]
    d = sessions.groupBy("fold", "event_code").agg(*[F.sum(c).alias(c) for c in counts], F.avg("edit_score").alias("edit_score"))
    both = (F.col("truth") > 0) & (F.col("negatives") > 0)
    return evaluation.rates(d, both).withColumn("false_alarms_per_hour", F.when(F.col("negatives") > 0, metrics.ratio(F.col("pred") - F.col("hits"), F.col("hours"))))


def summary(scored: DataFrame, points: DataFrame, bad: DataFrame) -> DataFrame:
    """fold, status, error, test_cows, test_points, posture_macro_f1, walking_ap, event_ap, selection_score."""
    size = scored.groupBy("fold").agg(F.countDistinct("cow_id").alias("test_cows"), F.count(F.lit(1)).alias("test_points"))
    known = scored.filter("body_target >= 0").select("fold", (F.col("body_target") == 1).cast("int").alias("actual"), (F.col(f"prob_{POSTURE}") >= 0.5).cast("int").alias("called"), (F.col("body_target") == 2).cast("int").alias("walks"), "prob_WALKING")
    posture = metrics.multiclass(known, "actual", "called", 2, ["fold"]).select("fold", F.col("macro_f1").alias("posture_macro_f1"))
    walking = metrics.average_precision(known, ["fold"], "walks", "prob_WALKING").withColumnRenamed("average_precision", "walking_ap")
    events = points.groupBy("fold").agg(F.avg("average_precision").alias("event_ap"))
    d = size
    for part in (posture, walking, events):
        d = join_groups(d, part, ["fold"], "left", fits=True)  # one row per fold
    d = d.withColumn("selection_score", metrics.selection_score(F.col("posture_macro_f1"), F.col("walking_ap"), F.col("event_ap")))
    d = d.select("fold", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error"), *d.columns[1:])
    return d.unionByName(bad.withColumn("status", F.lit("failed")), allowMissingColumns=True)


def overall(summary: DataFrame) -> DataFrame:
    """Folds complete and failed, mean, deviation and range of the selection score over folds."""
    s = F.col("selection_score")
    return summary.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(s).alias("mean_score"), F.stddev_pop(s).alias("sd_score"), F.min(s).alias("least_score"), F.max(s).alias("most_score"))
