"""Gradient-boosted tasks with held-out thresholds, and scoring."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import finite_or_zero
from ..operators.metrics import choose_threshold
from ..operators.splits import holdout
from ..sources.scratch import small
from .trees import Forest, Tree, fit_forests, probabilities

#: The posture head; what is derived from it is named in ``predict`` and nowhere else.
POSTURE = "posture_LYING"
LEAST_ROWS, LEAST_POSITIVES, MOST_WEIGHT = 50, 3, 1000.0
RESERVED = {"sample_id", "cache_key", "cow_id", "device_key", "device_mac", "session_id", "segment_id", "center_index", "center_time_ms", "body_target", "segment_start_index", "segment_stop_index"}


@dataclass(frozen=True)
class Settings:
    """Boosting of second order (M02): ``least_child`` is a sum of hessians, ``l2`` the leaves' penalty, ``bins`` cuts per feature plus one."""

    trees: int = 400
    rate: float = 0.05
    depth: int = 6
    subsample: float = 0.8
    columns: float = 0.8
    least_child: float = 5.0
    l2: float = 1.0
    bins: int = 256
    seed: int = 20260819


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither reserved nor labels."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double", "integer", "long", "short", "byte") and f.name not in RESERVED and not f.name.startswith(("event_", "mask_"))]


def cleaned(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as finite doubles."""
    return df.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in features})


@dataclass
class Task:
    """One fitted binary task."""

    name: str
    features: list[str]
    model: Forest
    threshold: float
    threshold_source: str

    def score(self, df: DataFrame) -> DataFrame:
        """``prob_NAME`` beside the input; a missing feature raises (P20)."""
        return score_all(df, [self])

    def importance(self) -> list[tuple[str, float]]:
        """Positive importances, largest first."""
        return self.model.importance()

    def save(self, path: str) -> None:
        """A JSON line of the task and one per tree."""
        spark = SparkSession.getActiveSession()
        meta = {"name": self.name, "features": self.features, "threshold": self.threshold, "threshold_source": self.threshold_source}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
        trees = [(json.dumps({"number": i} | asdict(t)),) for i, t in enumerate(self.model.trees)]
        spark.createDataFrame(trees, "value string").coalesce(1).write.text(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Task:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        trees = sorted((json.loads(r[0]) for r in spark.read.text(f"{path}/trees").collect()), key=lambda t: t.pop("number"))  # one line per tree
        return cls(meta["name"], meta["features"], Forest(meta["features"], [Tree(**t) for t in trees]), meta["threshold"], meta["threshold_source"])


def score_all(df: DataFrame, tasks: list[Task]) -> DataFrame:
    """``prob_NAME`` of every task, all forests in one pass over the rows; a missing feature raises (P20).

    A task that is no forest (it has name, threshold and ``score``) scores by itself.
    """
    forests = [t for t in tasks if isinstance(t, Task)]
    lost = sorted({c for t in forests for c in t.features} - set(df.columns))
    if lost:
        raise ValueError(f"missing model features: {lost}")
    for t in tasks:
        if not isinstance(t, Task):
            df = t.score(df)
    if not forests:
        return df
    out = df.withColumn("_probabilities", probabilities([t.model for t in forests]))
    return out.withColumns({f"prob_{t.name}": F.col("_probabilities")[i] for i, t in enumerate(forests)}).drop("_probabilities")


def train_many(df: DataFrame, labels: dict[str, tuple[str, str | None]], cow: str, features: list[str] | None = None, settings: Settings = Settings(), held: DataFrame | None = None) -> dict[str, Task]:
    """Fit tasks NAME: (label, mask) together, each on its supervised rows of all but the held-out animals (``held``, else
    a shuffled fifth of the task's), and choose thresholds on those (M03). Tasks with too little evidence are left out.

    Positives weigh their odds, at most 1000 (M01). Under 50 held-out rows or 3 positives the threshold is 0.5.
    """
    features = features or feature_columns(df)
    rows, names, states = cleaned(df, features), list(labels), {}
    own = {i: F.col(mask) == 1 if mask else F.lit(True) for i, (_, mask) in enumerate(labels.values())}
    if held is None:
        out = reduce(DataFrame.unionByName, [holdout(rows.filter(use), cow).select(F.col(cow).alias("_cow"), F.lit(i).alias("_task")) for i, use in own.items()])
    else:
        out = held.select(F.col(cow).alias("_cow"), F.explode(F.sequence(F.lit(0), F.lit(len(own) - 1))).alias("_task"))
    out = out.groupBy("_cow").agg(F.collect_set("_task").alias("_held"))
    rows = rows.join(small(out), rows[cow] == F.col("_cow"), "left")
    for i, (label, _) in enumerate(labels.values()):
        state = F.when(own[i] & F.col(label).isNotNull(), F.when(F.col(label).cast("double") > 0, 2).otherwise(1)).otherwise(0)
        kept_out = F.coalesce(F.array_contains("_held", i), F.lit(False))
        states |= {f"_fit{i}": F.when(~kept_out, state).otherwise(0), f"_check{i}": F.when(kept_out, state).otherwise(0)}
    rows = rows.select(*features, *[v.alias(k) for k, v in states.items()])
    count = lambda k, at: F.count(F.when(F.col(k) >= at, 1))
    counts = rows.agg(*[count(k, at).alias(f"{k}_{at}") for k in states for at in (1, 2)]).first()
    seen = {i: (counts[f"_fit{i}_1"], counts[f"_fit{i}_2"]) for i in range(len(names))}
    enough = [i for i, (n, positives) in seen.items() if n >= LEAST_ROWS and LEAST_POSITIVES <= positives < n]
    if not enough:
        return {}
    weights = [min((seen[i][0] - seen[i][1]) / seen[i][1], MOST_WEIGHT) for i in enough]
    s = settings
    forests = fit_forests(rows, features, [f"_fit{i}" for i in enough], weights, s.trees, s.rate, s.depth, s.subsample, s.columns, s.least_child, s.l2, s.bins, s.seed)
    tasks = {names[i]: Task(names[i], features, forest, 0.5, "default") for i, forest in zip(enough, forests, strict=True)}
    checked = [i for i in enough if counts[f"_check{i}_1"] >= LEAST_ROWS and counts[f"_check{i}_2"] >= LEAST_POSITIVES]
    if checked:  # all tasks' thresholds at once
        scored = score_all(rows.filter(F.greatest(*[f"_check{i}" for i in checked], F.lit(0)) > 0), [tasks[names[i]] for i in checked])
        each = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("task"), F.col(f"_check{i}").alias("state"), F.col(f"prob_{names[i]}").alias("score")) for i in checked]))
        long = scored.select(each.alias("x")).select("x.*").filter("state > 0").withColumn("actual", F.col("state") - 1)
        for r in choose_threshold(long, ["task"], "actual", "score").collect():  # one row per task
            tasks[r.task].threshold, tasks[r.task].threshold_source = r.threshold, "held-out animals"
    return tasks


def train(df: DataFrame, name: str, label: str, cow: str, features: list[str] | None = None, settings: Settings = Settings(), mask: str | None = None, held: DataFrame | None = None) -> Task | None:
    """One task of ``train_many``; None when evidence is too thin."""
    return train_many(df, {name: (label, mask)}, cow, features, settings, held).get(name)


def predict(df: DataFrame, tasks: list[Task], overrides: dict[str, float] | None = None) -> DataFrame:
    """All tasks' probabilities and the derived ones: UPRIGHT is 1 - LYING; absent heads have their defaults."""
    df = score_all(df, tasks)
    names = {t.name for t in tasks}
    absent = {f"prob_{h}": F.lit(v) for h, v in ((POSTURE, 0.5), ("WALKING", 0.0)) if h not in names}
    df = df.withColumns(absent).withColumn("prob_posture_UPRIGHT", 1 - F.col(f"prob_{POSTURE}"))
    for k, v in (overrides or {}).items():
        if not 0 < v < 1:
            raise ValueError(f"threshold of {k} must lie in (0, 1)")
    return df.withColumns({f"threshold_{t.name}": F.lit((overrides or {}).get(t.name, t.threshold)) for t in tasks})


def manifest(tasks: list[Task], settings: Settings) -> dict:
    """What a bundle was trained with."""
    return {"settings": asdict(settings), "tasks": [{"name": t.name, "features": len(t.features), "threshold": t.threshold, "threshold_source": t.threshold_source} for t in tasks]}
