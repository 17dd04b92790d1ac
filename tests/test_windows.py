"""The long baseline against loops, over batches that cut groups anywhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import windows


@pytest.mark.parametrize(("step", "window", "batch"), [(5, 4, 7), (3, 1, 10_000), (50, 1800, 64), (1, 6, 1)])
def test_long_baseline_against_loops(spark, step, window, batch):
    r = np.random.default_rng(step)
    rows = [(k, i, round(float(r.normal()), 1)) for k, n in (("a", 400), ("b", 1), (None, 33), ("c", 120)) for i in range(n)]
    want = {}
    for k in ("a", "b", None, "c"):
        x = [v for q, _, v in rows if q == k]
        for i in range(len(x)):
            at = i - i % step
            want[k, i] = np.median(x[at::-step][:window])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        d = spark.createDataFrame(rows, "k string, i int, v double").orderBy(F.rand(1))
        got = {(x.k, x.i): x.baseline for x in windows.long_baseline(d, "v", ["k"], ["i"], step, window).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
