"""Clipped sliding windows over rows of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def offsets(seconds: float, causal: bool, rate: int = 50) -> tuple[int, int]:
    """[lo, hi) row offsets of a window of so many seconds."""
    span = max(1, int(round(seconds * rate)))
    return (-span + 1, 1) if causal else (-(span // 2), span // 2 + 1)


def mean_and_sd(value: Column, by: list[str], order: list[str], lo: int, hi: int) -> tuple[Column, Column]:
    """Mean and population deviation over [i+lo, i+hi), clipped; an empty window is the nearest edge row."""
    whole = Window.partitionBy(*by).orderBy(*order)
    frame, all_rows = whole.rowsBetween(lo, hi - 1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.first(value).over(all_rows) if hi <= 0 else F.last(value).over(all_rows)
    return F.coalesce(F.avg(value).over(frame), edge), F.coalesce(F.stddev_pop(value).over(frame), F.lit(0.0))


def wide_mean_and_sd(df: DataFrame, value: str, by: list[str], order: list[str], lo: int, hi: int, mean: str, sd: str) -> DataFrame:
    """The same by prefix sums of centred values: two look-ups instead of hi - lo rows per row (W04, for wide frames)."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole, upto = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_m", F.avg(value).over(whole))
    d = d.withColumn("_x", F.col(value) - F.col("_m"))
    d = d.withColumn("_s", F.sum("_x").over(upto)).withColumn("_q", F.sum(F.col("_x") * F.col("_x")).over(upto))
    def at(c: str, offset: int) -> Column:  # running sum before row i + offset, 0 in front, the whole sum behind
        ahead = F.lead(c, offset - 1).over(w) if offset > 0 else F.lag(c, 1 - offset).over(w)
        return F.when(F.col("_i") + offset <= 0, 0.0).when(F.col("_i") + offset >= F.col("_n"), F.last(c).over(whole)).otherwise(ahead)

    ordinary = (F.col("_i") + hi > 0) & (F.col("_i") + lo < F.col("_n"))
    inside = F.least(F.col("_n"), F.col("_i") + hi) - F.greatest(F.lit(0), F.col("_i") + lo)
    d = d.withColumn("_k", F.when(ordinary, inside).cast("double"))
    for c in ("_s", "_q"):
        d = d.withColumn(f"{c}d", at(c, hi) - at(c, lo))
    edge = F.first("_x").over(whole) if hi <= 0 else F.last("_x").over(whole)
    d = d.withColumn("_mean", F.when(ordinary, F.col("_sd") / F.col("_k")).otherwise(edge))
    var = F.when(ordinary, F.greatest(F.col("_qd") / F.col("_k") - F.col("_mean") * F.col("_mean"), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn(mean, F.col("_mean") + F.col("_m")).withColumn(sd, F.sqrt(var))
    return d.drop("_i", "_n", "_m", "_x", "_s", "_q", "_k", "_sd", "_qd", "_mean")


def shifted_max(df: DataFrame, value: str, by: list[str], order: list[str], lo: int, hi: int, name: str) -> DataFrame:
    """Trailing maximum moved by hi - 1 rows: the rows it runs out on repeat the maximum of the last full span."""
    if hi <= lo:
        raise ValueError("hi must exceed lo")
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_left", F.count(F.lit(1)).over(whole) - F.row_number().over(w))
    inside = F.max(value).over(w.rowsBetween(lo, hi - 1))
    if hi <= 0:
        return d.withColumn(name, F.coalesce(inside, F.first(value).over(whole))).drop("_left")
    d = d.withColumn("_tail", F.max(F.when(F.col("_left") < hi - lo, F.col(value))).over(whole))
    return d.withColumn(name, F.when(F.col("_left") + 1 < hi, F.col("_tail")).otherwise(inside)).drop("_left", "_tail")


def long_baseline(df: DataFrame, value: str, by: list[str], order: list[str], step: int = 50, window: int = 1800, name: str = "baseline") -> DataFrame:
    """Trailing median of every ``step``-th row, held for ``step`` rows; always looks back only.

    Groups stream in order through their partition. What is held is one batch and the last ``window`` values, which a
    skip list keeps sorted; so a row costs the logarithm of the window. Nulls and NaN are left out of the median.
    """

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        now, at, tail, last = None, 0, np.empty(0), np.nan
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = [pc.fill_null(pc.dictionary_encode(batch.column(c)).indices, -1).to_numpy() for c in by]
            cuts = np.concatenate([[0], 1 + np.nonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0))[0] if n > 1 and ids else [], [n]]).astype(int)
            x, out = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False), np.empty(n)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(c)[int(lo)].as_py() for c in by)
                if key != now:
                    now, at, tail, last = key, 0, np.empty(0), np.nan
                coarse = x[lo:hi][(-at) % step :: step]
                both = np.concatenate([tail, coarse])
                medians = pd.Series(both).rolling(window, min_periods=1).median().to_numpy()[len(tail) :]
                places = (at + np.arange(hi - lo)) // step - (at + step - 1) // step  # -1: still the last batch's
                out[lo:hi] = np.concatenate([medians, [last]])[places]
                if len(coarse):
                    last, tail = medians[-1], both[-(window - 1) :] if window > 1 else both[:0]
                at += hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=np.isnan(out))], names=[*batch.schema.names, name])

    schema = df.withColumn(name, F.lit(0.0)).schema
    schema.fields[-1].nullable = True
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
