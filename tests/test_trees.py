"""Boosting of second order against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from kinetrace.models import boosting, trees


def plain_forest(x, y, weight, cuts, rounds, rate, depth, least, l2):
    """Margins of all rows by boosting with exact loops over nodes, features and cuts."""
    margins = [0.0] * len(x)
    for _ in range(rounds):
        g, h = [], []
        for m, label in zip(margins, y, strict=True):
            p, w = 1 / (1 + math.exp(-m)), weight if label else 1.0
            g.append(w * (p - label))
            h.append(w * p * (1 - p))

        def grow(rows, left):
            total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = None
            for f in range(len(x[0])) if left else ():
                for c in cuts[f]:
                    low = [i for i in rows if x[i][f] <= c]
                    a, b = sum(g[i] for i in low), sum(h[i] for i in low)
                    if b < least or total_h - b < least:
                        continue
                    gain = a * a / (b + l2) + (total_g - a) ** 2 / (total_h - b + l2) - total_g**2 / (total_h + l2)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-4):
                        best = gain, f, c
            if best is None:
                for i in rows:
                    margins[i] -= rate * total_g / (total_h + l2)
                return
            _, f, c = best
            grow([i for i in rows if x[i][f] <= c], left - 1)
            grow([i for i in rows if x[i][f] > c], left - 1)

        grow(list(range(len(x))), depth)
    return margins


def sample(spark, n=500):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 12, n), r.integers(0, 7, n), r.integers(0, 30, n)]).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + r.normal(0, 2, n) > 12).astype(int)
    z = (x[:, 2] > 24).astype(int)
    rows = [(i, *map(float, v), int(a) + 1, int(b) + 1 if i % 3 else 0) for i, (v, a, b) in enumerate(zip(x, y, z, strict=True))]
    return x, y, z, spark.createDataFrame(rows, "i long, f0 double, f1 double, f2 double, a int, b int").repartition(5)


FIXED = {"rate": 0.4, "depth": 3, "subsample": 1.0, "columns": 1.0, "least_child": 4.0, "l2": 1.0, "bins": 256, "seed": 1}


def test_forests_equal_loops(spark):
    x, y, z, d = sample(spark)
    own = [i for i in range(len(x)) if i % 3]
    weights = [(y == 0).sum() / y.sum(), (z[own] == 0).sum() / z[own].sum()]
    forests = trees.fit_forests(d, ["f0", "f1", "f2"], ["a", "b"], weights, trees=3, **FIXED)
    cuts = [sorted(set(x[:, f])) for f in range(3)]
    got = [r.p for r in d.withColumn("p", trees.probabilities(forests)).sort("i").collect()]
    for t, (rows, label) in enumerate(((range(len(x)), y), (own, z))):
        margins = plain_forest([list(x[i]) for i in rows], [int(label[i]) for i in rows], weights[t], cuts, 3, 0.4, 3, 4.0, 1.0)
        assert max(abs(1 / (1 + math.exp(-m)) - got[i][t]) for i, m in zip(rows, margins, strict=True)) < 1e-4
    assert forests[1].importance()[0][0] == "f2"


def test_forests_do_not_depend_on_partitions(spark, monkeypatch):
    _, _, _, d = sample(spark)
    grow = lambda rows: trees.fit_forests(rows, ["f0", "f1", "f2"], ["a", "b"], [2.0, 3.0], trees=5, **(FIXED | {"subsample": 0.7, "columns": 0.7}))
    a, b = grow(d), grow(d.repartition(11, "f1"))
    monkeypatch.setattr(trees, "REFRESH", 2)  # margins written in between
    assert a == b == grow(d.coalesce(1))
    assert len({tuple(t.feature) for t in a[0].trees}) > 1


def test_penalty_and_least_child(spark):
    _, _, _, d = sample(spark)
    grow = lambda **more: trees.fit_forests(d, ["f0", "f1", "f2"], ["a"], [1.0], trees=1, **(FIXED | more))[0].trees[0]
    plain, strong = grow(l2=0.0), grow(l2=100.0)
    assert max(map(abs, strong.value)) < max(map(abs, plain.value)) / 2
    alone = grow(least_child=1e6)
    assert alone.feature == [-1] * 15 and alone.value[0] != 0


def test_odd_rows(spark):
    rows = [(f"c{i % 8}", float("nan") if i % 5 == 0 else float(i % 9), None if i % 7 == 0 else 1.0, None if i % 11 == 0 else int(i % 9 > 4)) for i in range(900)]
    d = spark.createDataFrame(rows, "cow_id string, f0 double, f1 double, event_A int")
    s = boosting.Settings(trees=4, rate=0.5, depth=2)
    tasks = boosting.train_many(d, {"A": ("event_A", None), "B": ("event_A", "f1")}, "cow_id", ["f0", "f1"], s)
    assert set(tasks) == {"A", "B"}
    out = boosting.predict(d, list(tasks.values()))
    assert out.filter("prob_A IS NULL OR isnan(prob_A)").count() == 0 and out.filter(F.isnan("f0")).count() == 180
    none = d.filter("false")
    assert boosting.train_many(none, {"A": ("event_A", None)}, "cow_id", ["f0", "f1"], s) == {}
    assert boosting.predict(none, list(tasks.values())).count() == 0
