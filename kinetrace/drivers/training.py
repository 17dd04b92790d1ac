"""Training of the nine boosted tasks and their bundle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENTS
from ..models.boosting import POSTURE, Settings, Task, feature_columns, train_many
from ..sources import sinks
from ..sources.scratch import written

TASKS = (POSTURE, "WALKING", *EVENTS)


def targets(df: DataFrame) -> DataFrame:
    """Per task ``label_NAME`` and ``use_NAME`` of label rows with body_target, event_* and mask_*."""
    known = (F.col("body_target") >= 0).cast("int")
    own = {f"label_{POSTURE}": (F.col("body_target") == 1).cast("int"), f"use_{POSTURE}": known, "label_WALKING": (F.col("body_target") == 2).cast("int"), "use_WALKING": known}
    return df.withColumns(own | {f"label_{e}": F.col(f"event_{e}") for e in EVENTS} | {f"use_{e}": F.col(f"mask_{e}") for e in EVENTS})


def train_tasks(df: DataFrame, cow: str = "cow_id", features: list[str] | None = None, settings: Settings = Settings(), version: int = 2, held: DataFrame | None = None) -> tuple[list[Task], dict]:
    """(tasks, summary): every task whose evidence suffices, trained on its supervised rows; skipped ones are in the summary.

    The feature table is written once with the targets; all tasks grow level by level in the same jobs.
    """
    features = features or feature_columns(df)
    rows = written(targets(df).select(cow, *features, *[f"{k}_{t}" for t in TASKS for k in ("label", "use")]), "training-rows")
    found = train_many(rows, {t: (f"label_{t}", f"use_{t}") for t in TASKS}, cow, features, settings, held)
    tasks = [found[t] for t in TASKS if t in found]
    skipped = {name: "under 50 rows or 3 positives" for name in TASKS if name not in found}
    return tasks, {"feature_version": version, "features": features, "trained": [t.name for t in tasks], "skipped": skipped, "thresholds": {t.name: t.threshold for t in tasks}, "threshold_sources": {t.name: t.threshold_source for t in tasks}, "importance": {t.name: t.importance()[:20] for t in tasks}}


def save_bundle(spark: SparkSession, tasks: list[Task], summary: dict, path: str) -> None:
    """A folder with each task's model and one summary document."""
    for t in tasks:
        t.save(f"{path}/{t.name}")
    sinks.write_json(spark, summary, f"{path}/summary")


def load_bundle(spark: SparkSession, path: str) -> tuple[list[Task], dict]:
    summary = json.loads(json.dumps(sinks.read_json(spark, f"{path}/summary")))
    return [Task.load(spark, f"{path}/{name}") for name in summary["trained"]], summary
