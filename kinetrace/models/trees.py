"""Second-order boosted trees with an L2 term: histograms of gradients, one job per level for all tasks.

Rows are binned once into a written table of blocks, which workers read as arrays, without an object per row. A level's job sums gradients and hessians per task, node, feature and bin in
each worker (numpy), adds these sums up by key, and finds the best split of every node in windows over at most ``bins``
rows; the driver gets one short row per node. Gradients are added as integers in units of 2^-20, so that sums, and with
them the trees, do not depend on the order or the place in which rows are read.

A worker holds one level's sums: tasks x nodes x features x bins x 16 bytes, 141 MB for nine tasks at depth 6 with 120
features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import finite_or_zero
from ..sources.scratch import written

#: Unit of the summed gradients and hessians.
UNIT = 1 << 20
#: Gains up to this are none.
LEAST_GAIN = 1e-6
#: Trees after which the rows' margins are written again.
REFRESH = 20
#: Bytes of a block, rows that a worker adds up in one step, and bytes of a row group, which a reader holds.
BLOCK, STEP, GROUP = 1 << 16, 10_000, {"parquet.block.size": 1 << 24}


@dataclass
class Tree:
    """A full binary tree in arrays; the children of node i are 2i + 1 (value <= cut) and 2i + 2; feature -1 is a leaf."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def nodes(self, x: np.ndarray, limits: list) -> np.ndarray:
        """The node at which each row of ``x`` (values against ``cut``, bins against ``bin``) ends."""
        feature, here = np.asarray(self.feature), np.arange(len(self.feature))
        inner = feature >= 0
        f, left, limit = np.maximum(feature, 0), np.where(inner, 2 * here + 1, here), np.where(inner, limits, np.inf)  # leaves keep their rows
        values, start, at = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), "i8")
        for _ in range(int(here[inner].max(initial=-1) + 1).bit_length()):
            at = left.take(at) + (values.take(start + f.take(at)) > limit.take(at))
        return at


@dataclass
class Forest:
    """The trees of one task over named features."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += np.asarray(t.value)[t.nodes(x, t.cut)]
        return total

    def importance(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits as a share of all features', largest first."""
        sums: dict[int, list[float]] = {}
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    sums.setdefault(f, []).append(g)
        means = {f: sum(g) / len(g) for f, g in sums.items()}
        return sorted(((self.features[f], m / sum(means.values())) for f, m in means.items()), key=lambda x: (-x[1], x[0]))


def probabilities(forests: list[Forest]) -> Column:
    """array<double>: each forest's probability; nulls and values that are not finite count as 0."""
    names = sorted({c for f in forests for c in f.features})
    places = [[names.index(c) for c in f.features] for f in forests]

    def score(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        p = np.column_stack([1 / (1 + np.exp(-f.margins(x[:, own]))) for f, own in zip(forests, places, strict=True)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(forests), pa.int32()), pa.array(p.ravel()))

    score.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "array<double>")(*[finite_or_zero(F.col(c).cast("double")) for c in names])


def edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature at most bins - 1 ascending cuts at its quantiles; every value of a share over 1 / bins is one."""
    at = [i / bins for i in range(bins)]
    found = rows.agg(*[F.percentile_approx(c, at, 100 * bins).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(q or []))[: bins - 1] for q in found]


def binned(rows: DataFrame, features: list[str], states: list[str], cuts: list[list[float]]) -> DataFrame:
    """Blocks of rows; of each row, one after another: bins (a byte per feature), state (a byte per task: 0 unused, 1 negative,
    2 positive), draw, margins.

    ``draw`` is a hash of the row's own values, so that a row is sampled alike in every run; equal rows are drawn alike.
    """
    size = block_rows(len(features), len(states))

    def pack(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, size):
                batch = whole.slice(k, size)
                b = np.column_stack([np.searchsorted(np.asarray(c, "f8"), batch.column(f"f{i}").to_numpy(), side="left").astype("u1") for i, c in enumerate(cuts)])
                s = np.column_stack([batch.column(f"s{i}").to_numpy().astype("u1") for i in range(len(states))])
                parts = b, s, batch.column("draw").to_numpy().astype("<i8"), np.zeros(s.shape, "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["bins", "state", "draw", "margins"])

    flat = rows.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(features)], *[F.col(c).cast("int").alias(f"s{i}") for i, c in enumerate(states)], F.xxhash64(*features, *states).alias("draw"))
    return flat.mapInArrow(pack, "bins binary, state binary, draw binary, margins binary")


def block_rows(n_features: int, n_tasks: int) -> int:
    return max(1, BLOCK // (n_features + 9 * n_tasks + 8))


def matrix(column, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def drawn(draw: np.ndarray, tree: int, task: int, share: float) -> np.ndarray:
    """Which rows a tree of a task sees: a mix of the row's draw with both numbers, below the share."""
    with np.errstate(over="ignore"):
        x = draw.astype("u8") ^ np.uint64((0x9E3779B97F4A7C15 * (tree * 1009 + task + 1)) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype("f8") * 2.0**-53 < share


def advanced(batch, pending: list[dict[int, Tree]], n_features: int, n_tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, margins) of blocks with the trees that their margins lack."""
    x, margins = matrix(batch.column("bins"), "u1", n_features), matrix(batch.column("margins"), "<f8", n_tasks).copy()
    for grown in pending:
        for t, tree in grown.items():
            margins[:, t] += np.asarray(tree.value)[tree.nodes(x, tree.bin)]
    return x, margins


def level_sums(table: DataFrame, pending: list[dict[int, Tree]], now: dict[int, Tree], level: int, number: int, weights: list[float], columns: dict[int, list[int]], n_features: int, bins: int, share: float) -> DataFrame:
    """task, node, feature, bin, g, h of the nodes of a level, each worker's sums by themselves."""
    first, slots, n_tasks = 2**level - 1, 2**level, len(weights)
    step = max(1, STEP // block_rows(n_features, n_tasks))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, step):  # integers below 2^53 in the doubles of a step's sums
                batch = whole.slice(k, step)
                x, margins = advanced(batch, pending, n_features, n_tasks)
                state, draw = matrix(batch.column("state"), "u1", n_tasks), matrix(batch.column("draw"), "<i8", 1)[:, 0]
                for t, tree in now.items():
                    at = tree.nodes(x, tree.bin)
                    live = np.nonzero((state[:, t] > 0) & (at >= first) & drawn(draw, number, t, share))[0]
                    if not len(live):
                        continue
                    y = (state[live, t] == 2).astype("f8")
                    w, p = np.where(y > 0, weights[t], 1.0), 1 / (1 + np.exp(-margins[live, t]))
                    g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
                    own = sums.setdefault(t, np.zeros((2, len(columns[t]), slots * bins), "i8"))
                    for i, f in enumerate(columns[t]):
                        place = (at[live] - first) * bins + x[live, f]
                        own[0, i] += np.bincount(place, g, slots * bins).astype("i8")
                        own[1, i] += np.bincount(place, h, slots * bins).astype("i8")
        for t, own in sums.items():
            for i, f in enumerate(columns[t]):
                place = np.nonzero(own[0, i] | own[1, i])[0]
                fixed = lambda v, kind, n=len(place): pa.array(np.full(n, v), kind)
                yield pa.RecordBatch.from_arrays([fixed(t, pa.int32()), pa.array(place // bins + first, pa.int32()), fixed(f, pa.int32()), pa.array(place % bins, pa.int32()), pa.array(own[0, i][place]), pa.array(own[1, i][place])], names=["task", "node", "feature", "bin", "g", "h"])

    return table.mapInArrow(add, "task int, node int, feature int, bin int, g long, h long")


def best_splits(sums: DataFrame, l2: float, least_child: float) -> DataFrame:
    """Per task and node: its sums g, h, and ``best``, the split of most gain with both children's sums (null where none gains).

    Ties go to the smaller feature, then the smaller bin.
    """
    own = Window.partitionBy("task", "node", "feature")
    d = sums.repartition("task", "node", "feature").groupBy("task", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[(F.sum(c).over(upto) / UNIT).alias(f"{c}l") for c in ("g", "h")], *[(F.sum(c).over(own) / UNIT).alias(f"{c}a") for c in ("g", "h")])
    gl, hl, g, h = (F.col(c) for c in ("gl", "hl", "ga", "ha"))
    term = lambda a, b: a * a / (b + l2)
    gain = term(gl, hl) + term(g - gl, h - hl) - term(g, h)
    fits = (hl >= least_child) & (h - hl >= least_child) & (gain > LEAST_GAIN)
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")
    return d.groupBy("task", "node").agg(F.max(F.when(fits, split)).alias("best"), F.max("ga").alias("g"), F.max("ha").alias("h"))


def fit_forests(rows: DataFrame, features: list[str], states: list[str], weights: list[float], trees: int, rate: float, depth: int, subsample: float, columns: float, least_child: float, l2: float, bins: int, seed: int) -> list[Forest]:
    """One forest per column of ``states`` (0 unused, 1 negative, 2 positive); positives weigh ``weights``.

    ``features`` are finite doubles. A tree draws its rows and features; a node splits where the penalised gain
    G^2 / (H + l2) of its children exceeds its own and both have a hessian sum of ``least_child``. Leaves are
    -rate G / (H + l2). Only split rows of a level (tasks x nodes) reach the driver.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie in 2 to 256")
    used = rows.filter(F.greatest(*states, F.lit(0)) > 0)
    cuts = edges(used, features, bins)
    table = written(binned(used, features, states, cuts), "boosting-rows", **GROUP)
    forests = [Forest(list(features)) for _ in states]
    draws = np.random.default_rng(seed)
    share = max(1, round(columns * len(features)))
    pending: list[dict[int, Tree]] = []
    for number in range(trees):
        now = {t: Tree.empty(depth) for t in range(len(states))}
        chosen = {t: sorted(draws.permutation(len(features))[:share].tolist()) for t in now}
        open_tasks = dict(now)
        for level in range(depth):
            sums = level_sums(table, pending, open_tasks, level, number, weights, chosen, len(features), bins, subsample)
            grew = set()
            for r in best_splits(sums, l2, least_child).collect():
                tree, i = now[r.task], r.node
                if level == 0:
                    tree.value[0] = -rate * r.g / (r.h + l2)
                if r.best is None:
                    continue
                f, b = -r.best.f, -r.best.b
                tree.feature[i], tree.bin[i], tree.cut[i], tree.gain[i] = f, b, float(cuts[f][b]), r.best.gain
                tree.value[2 * i + 1] = -rate * r.best.gl / (r.best.hl + l2)
                tree.value[2 * i + 2] = -rate * (r.g - r.best.gl) / (r.h - r.best.hl + l2)
                grew.add(r.task)
            open_tasks = {t: now[t] for t in sorted(grew)}
            if not grew:
                break
        for t, tree in now.items():
            forests[t].trees.append(tree)
        pending.append(now)
        if len(pending) == REFRESH and number + 1 < trees:
            table, pending = written(with_margins(table, pending, len(features), len(states)), "boosting-rows", **GROUP), []
    return forests


def with_margins(table: DataFrame, pending: list[dict[int, Tree]], n_features: int, n_tasks: int) -> DataFrame:
    """The binned table with the margins of more trees."""

    def add(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                margins = advanced(batch, pending, n_features, n_tasks)[1]
                yield batch.set_column(3, "margins", pa.array([margins.tobytes()], pa.binary()))

    return table.mapInArrow(add, table.schema)
