"""Posture state machine and its tuning."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import multiclass
from .timeline import over, with_segments


@dataclass(frozen=True)
class Machine:
    confirm: int = 4
    dwell: int = 4
    margin: float = 0.10
    event_weight: float = 0.50
    gap: int = 750


@dataclass
class State:
    """What a run carries from one point to the next: the whole of it, so that a stream can store it."""

    state: int = -1
    asking: int = 0
    dwell: int = 0

    def step(self, m: Machine, upright: float, lying: float, up: float, down: float) -> int:
        if self.state < 0:
            self.state, self.dwell = int(lying > upright), m.dwell
            return self.state
        to_lying, to_upright = lying + m.event_weight * down, upright + m.event_weight * up
        other = to_lying > to_upright + m.margin if self.state == 0 else to_upright > to_lying + m.margin
        self.asking = self.asking + 1 if other else 0
        if other and self.dwell >= m.dwell and self.asking >= m.confirm:
            self.state, self.asking, self.dwell = 1 - self.state, 0, 0
        self.dwell += 1
        return self.state


def smooth(df: DataFrame, by: list[str], time: str, machine: Machine = Machine()) -> DataFrame:
    """``df`` (by, time, upright, lying, up, down) with state_raw and state_sm; runs end at gaps.

    A point of its predecessor's time starts a run; points of one time are ordered by their values.
    """
    runs = with_segments(df, by, time, machine.gap, [time, "upright", "lying", "up", "down"], "_run").withColumn("state_raw", (F.col("lying") > F.col("upright")).cast("int"))

    schema = T.StructType([*runs.schema.fields, T.StructField("state_sm", T.IntegerType())])

    def walk(frames):
        now, state = None, State()
        for pdf in frames:
            keys, out = list(zip(*(pdf[c] for c in (*by, "_run")), strict=True)), []
            for key, *row in zip(keys, pdf["upright"], pdf["lying"], pdf["up"], pdf["down"], strict=True):
                if key != now:
                    now, state = key, State()
                out.append(state.step(machine, *row))
            yield pdf.assign(state_sm=np.array(out, "i4"))

    # runs stream through their partition in order: no group is held, and a long series spreads by its runs
    return runs.repartition(*by, "_run").sortWithinPartitions(*by, "_run", time).mapInPandas(walk, schema).drop("_run")


GRID = [Machine(c, d, m, w) for c, d, m, w in product((2, 4, 6, 10), (2, 4, 10, 20), (0.0, 0.10, 0.20, 0.30), (0.0, 0.25, 0.50, 1.0))]


def tune(df: DataFrame, by: list[str], time: str, target: str, gap: int = 750, grid: list[Machine] = GRID) -> DataFrame:
    """Per machine its macro F1; ``best`` marks the highest, then the least confirm + dwell, then the first.

    One pass steps all machines at once, as arrays, through each partition's runs and emits its confusion counts only.
    """
    runs = with_segments(df.filter(F.col(target) >= 0), by, time, gap, name="_run")
    confirm, dwell_min, margin, weight = (np.array([getattr(m, k) for m in grid]) for k in ("confirm", "dwell", "margin", "event_weight"))
    rows = runs.select(*by, "_run", time, "upright", "lying", "up", "down", F.col(target).cast("int").alias("_y"))

    def count(batches):
        import pyarrow as pa

        n, now = np.zeros((len(grid), 2, 2), "i8"), None
        every = np.arange(len(grid))
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "_run")), strict=True))
            upright, lying, up, down, truth = (batch.column(c).to_numpy() for c in ("upright", "lying", "up", "down", "_y"))
            for i, key in enumerate(keys):
                if key != now:
                    now, state = key, np.full(len(grid), int(lying[i] > upright[i]))
                    asking, dwell = np.zeros(len(grid), "i8"), dwell_min.copy()
                else:
                    to_lying, to_upright = lying[i] + weight * down[i], upright[i] + weight * up[i]
                    other = np.where(state == 0, to_lying > to_upright + margin, to_upright > to_lying + margin)
                    asking = np.where(other, asking + 1, 0)
                    turn = other & (dwell >= dwell_min) & (asking >= confirm)
                    state = np.where(turn, 1 - state, state)
                    asking[turn] = 0
                    dwell = np.where(turn, 0, dwell) + 1
                n[every, truth[i], state] += 1
        m, a, p = np.indices(n.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype("i4")), pa.array(a.astype("i4")), pa.array(p.astype("i4")), pa.array(n.reshape(-1))], names=["machine", "actual", "predicted", "n"])

    counts = rows.repartition(*by).sortWithinPartitions(*by, "_run", time).mapInArrow(count, "machine int, actual int, predicted int, n long")
    c = counts.groupBy("machine").agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0)).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])
    f1 = lambda t, x, y: F.coalesce(2 * F.col(t) / F.nullif(2 * F.col(t) + F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    c = c.withColumn("macro_f1", (f1("c00", "c01", "c10") + f1("c11", "c01", "c10")) / 2)
    settings = df.sparkSession.createDataFrame([(i, m.confirm, m.dwell, m.margin, m.event_weight) for i, m in enumerate(grid)], "machine int, confirm int, dwell int, margin double, event_weight double")
    c = c.join(F.broadcast(settings), "machine")
    rank = F.row_number().over(Window.orderBy(F.col("macro_f1").desc(), F.col("confirm") + F.col("dwell"), "machine"))
    return c.withColumn("best", rank == 1)


def state_changes(df: DataFrame, by: list[str], time: str, columns: list[str]) -> DataFrame:
    """Number of changes of each state column along each series."""
    w = over(by, [time])
    return df.select(*[F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False)).cast("int").alias(c) for c in columns]).agg(*[F.sum(c).alias(f"{c}_changes") for c in columns])


def state_scores(df: DataFrame, target: str) -> DataFrame:
    """Macro F1 of the raw and the smoothed states."""
    raw, sm = (multiclass(df, target, c, 2).select(F.lit(c).alias("states"), "evaluated", "macro_f1") for c in ("state_raw", "state_sm"))
    return raw.union(sm)
