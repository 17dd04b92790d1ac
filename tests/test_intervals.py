"""Interval joins over dyadic blocks against loops: long, short, empty and negative intervals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import intervals


def test_cover_is_disjoint_and_short(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(r.integers(-10_000, 10_000, 200), r.integers(0, 5_000, 200), strict=True))]
    rows += [(900, 0, 31_536_000_000), (901, -1, 1), (902, 7, 7), (903, -(2**41), 2**41)]
    got = {}
    for x in intervals.cover(spark.createDataFrame(rows, "i long, s long, e long"), F.col("s"), F.col("e"), 10).collect():
        got.setdefault(x.i, []).append((x._block << x._level, (x._block + 1) << x._level))
    for i, s, e in rows:
        leaves = s // 10, (max(e - 1, s)) // 10 + 1
        parts = sorted(got[i])
        assert parts[0][0] == leaves[0] and parts[-1][1] == leaves[1] and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * math.log2(leaves[1] - leaves[0]) + 2


def test_points_and_overlaps_against_loops(spark):
    r = np.random.default_rng(2)
    spans = lambda n, k: [(i, int(g), int(s), int(s + w)) for i, (g, s, w) in enumerate(zip(r.integers(0, 3, n), r.integers(-3000, 3000, n), r.choice([0, 1, 5, 40, 900, 20_000], n), strict=True))]
    a, b, p = spans(120, 0), spans(120, 1), [(i, int(g), int(t)) for i, (g, t) in enumerate(zip(r.integers(0, 3, 400), r.integers(-4000, 24_000, 400), strict=True))]
    da, db = spark.createDataFrame(a, "i long, g int, s long, e long"), spark.createDataFrame(b, "j long, g int, s2 long, e2 long")
    dp = spark.createDataFrame(p, "k long, g int, t long").repartition(3)
    for leaf in (1, 16, 100_000):
        got = [(x.k, x.i) for x in intervals.points_in(dp, da, ["g"], "t", "s", "e", leaf).collect()]
        assert sorted(got) == sorted((k, i) for k, g, t in p for i, h, s, e in a if g == h and s <= t < e)
        got = [(x.i, x.j) for x in intervals.overlap_pairs(da, db, ["g"], leaf, ("s", "e"), ("s2", "e2")).collect()]
        assert sorted(got) == sorted((i, j) for i, g, s, e in a for j, h, s2, e2 in b if g == h and s < e2 and e > s2)
    assert intervals.points_in(dp, da.limit(0), ["g"], "t", "s", "e", 16).count() == 0


def plain_greedy(pairs):
    """Pairs in order of group, rank and numbers; each side once."""
    truths, preds, out = set(), set(), []
    for g, r, t, p in sorted(pairs, key=lambda x: (x[0], x[1], x[2], x[3])):
        if (g, t) not in truths and (g, p) not in preds:
            truths.add((g, t))
            preds.add((g, p))
            out.append((g, t, p))
    return sorted(out)


@pytest.mark.parametrize("folded", [0, 3, 40, 10**6])
def test_matching_by_rounds_equals_the_fold(spark, folded):
    """Groups with ties, a chain in which each pair waits for the one before, one side that meets all, repeated pairs."""
    r = random.Random(3)
    pairs = [("many", r.randrange(4), r.randrange(30), r.randrange(30)) for _ in range(200)]
    pairs += [("chain", i, (i + 1) // 2, i // 2) for i in range(60)]
    pairs += [("hub", 60 - i, 0, i) for i in range(60)] + [("one", 0, 1, 1)] * 3
    d = spark.createDataFrame(pairs, "g string, r int, a int, b int")
    got = intervals.greedy(d, ["g"], [F.col("r")], "a", "b", folded)
    assert sorted(map(tuple, got.collect())) == plain_greedy(pairs)


def test_matching_of_no_pairs(spark):
    d = spark.createDataFrame([(None, 1, 1, 1), ("x", 1, None, 1), ("x", 1, 1, None)], "g string, r int, a int, b int")
    assert intervals.greedy(d, ["g"], [F.col("r")], "a", "b").count() == 0
