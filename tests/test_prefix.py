"""Running totals and quantiles over ranges against numpy, one hot group and null keys included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import metrics, prefix


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    return [("hot", float(x)) for x in r.permutation(6000)] + [("b", float(x)) for x in r.normal(size=40).round(1)] + [(None, 2.5), (None, 1.5), ("one", -3.0)]


def test_running_and_spread(spark, rows):
    d = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).repartition(5)
    out, few = prefix.running(d, ["k"], [F.col("v").desc()], {"upto": "n"}, {"all": "n"})
    assert few
    got = {}
    for x in out.collect():
        got.setdefault(x.k, []).append((x.v, x.n, x.upto, x.all))
    for k in {k for k, _ in rows}:
        v, n = np.unique([y for x, y in rows if x == k], return_counts=True)
        assert [g[:3] for g in sorted(got[k], reverse=True)] == list(zip(v[::-1], n[::-1], np.cumsum(n[::-1]), strict=True))
        assert {g[3] for g in got[k]} == {n.sum()}
    dealt = d.repartitionByRange(4, "k", F.col("v").desc()).filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 3 and max(x["count"] for x in dealt) < 3000  # a hot group lies in several ranges


def test_quantiles(spark, rows):
    d = spark.createDataFrame([*rows, ("b", None), ("void", None)], "k string, v double")
    at = {"low": 0.0, "q25": 0.25, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = {x.k: tuple(x)[1:] for x in prefix.quantiles(d, ["k"], F.col("v"), at).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        assert got[k] == pytest.approx([np.quantile([y for x, y in rows if x == k], p) for p in at.values()], abs=1e-12)
    whole = prefix.quantiles(d, [], F.col("v"), {"m": 0.3}).collect()
    assert whole[0].m == pytest.approx(np.quantile([y for _, y in rows], 0.3))
    assert [x.m for x in prefix.quantiles(d.filter("k = 'void'"), [], F.col("v"), {"m": 0.5}).collect()] == [None]


def test_curve_of_one_group_against_loops(spark):
    r = np.random.default_rng(4)
    y, p = r.integers(0, 2, 3000), r.random(3000).round(3)
    d = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, p, strict=True)], "g int, y int, p double")
    total, ap, best = y.sum(), 0.0, []
    for s in np.unique(p)[::-1]:
        tp, called = y[p >= s].sum(), (p >= s).sum()
        ap += y[p == s].sum() / total * tp / called
        best.append((2 * tp / (called + total), -abs(s - 0.5), -s, called / 3000))
    assert metrics.average_precision(d, ["g"], "y", "p").first().average_precision == pytest.approx(ap, abs=1e-12)
    top = max(b[0] for b in best)
    assert metrics.choose_threshold(d, ["g"], "y", "p").first().threshold == -max(b[1:3] for b in best if b[0] >= top - 1e-12)[1]
    few = [b for b in best if b[3] <= 0.2]
    top = max(b[0] for b in few)
    assert metrics.choose_threshold(d, ["g"], "y", "p", most_positive=0.2).first().threshold == -max(b[1:3] for b in few if b[0] >= top - 1e-12)[1]
