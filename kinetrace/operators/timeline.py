"""Runs, grids, masks and resampling over ordered points. Everything is partitioned by entity (and segment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def with_segments(df: DataFrame, by: list[str], time: str, gap: int, order: list[str] | None = None, name: str = "segment") -> DataFrame:
    """Run number from 0: a step that is not positive or exceeds the gap starts a run."""
    w = over(by, order or [time])
    step = F.col(time) - F.lag(time).over(w)
    return df.withColumn(name, F.sum(F.when((step <= 0) | (step > gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def segment_bounds(df: DataFrame, by: list[str], time: str, segment: str = "segment") -> DataFrame:
    """One row per run: start, stop, points."""
    return df.groupBy(*by, segment).agg(F.min(time).alias("start_t"), F.max(time).alias("stop_t"), F.count(F.lit(1)).alias("points"))


def label_grid(bounds: DataFrame, by: list[str], start: str, stop: str, step: int) -> DataFrame:
    """Every ``step``-th index of each half-open range, from its start."""
    last = F.greatest(F.col(start), F.col(stop) - 1)
    return bounds.filter(F.col(stop) > F.col(start)).select(*by, F.explode(F.sequence(F.col(start), last, F.lit(step).cast("long"))).alias("center"))


def resample_linear(df: DataFrame, by: list[str], time: str, value: str, step: int, jitter: int | None = None, nominal: int | None = None) -> DataFrame:
    """Linear interpolation onto multiples of ``step``, each grid point from the raw interval that holds it.

    The interval (t_k, t_k+1] owns its grid points; the first point of a series owns itself. ``flagged`` tells
    whether that interval's length is off the nominal by more than the jitter. Interpolated values are rounded half
    to even. One explode per raw interval, no join.
    """
    w = over(by, [time])
    rows = df.select(*by, F.col(time).alias("t1"), F.col(value).alias("v1"), F.lag(time).over(w).alias("t0"), F.lag(value).over(w).alias("v0"))
    low = F.when(F.col("t0").isNull(), F.ceil(F.col("t1") / step)).otherwise(F.floor(F.col("t0") / step) + 1)
    high = F.floor(F.col("t1") / step)
    rows = rows.withColumn("g", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))).withColumn("grid_t", F.col("g") * step)
    exact = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("grid_t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    out = rows.withColumn("resampled", F.rint(F.when(F.col("t0").isNull() | (F.col("grid_t") == F.col("t1")), F.col("v1")).otherwise(exact)))
    flag = F.lit(False) if jitter is None else F.coalesce(F.abs(F.col("t1") - F.col("t0") - F.lit(nominal or step)) > jitter, F.lit(False))
    return out.select(*by, "grid_t", "resampled", flag.cast("int").alias("flagged"))


def resample_session(frames: DataFrame, by: list[str], order: str, time: str, values: list[str], gap: int = 40, step: int = 20, least: int = 256, jitter: int = 2) -> tuple[DataFrame, DataFrame]:
    """(signal, segments) of whole sessions on the common grid; nothing is interpolated across a gap.

    A run is kept that has ``least`` frames and as many grid points. Kept runs are numbered from 0 and their grid points
    (``frame_index``) run on through the session; values are rounded half to even; ``quality`` is 1 where the raw step
    around a grid point is off the nominal by more than the jitter. ``segments`` has segment_id, start_index,
    stop_index, start_ms, stop_ms.
    """
    runs = with_segments(frames, by, time, gap, [order], "_run")
    own = [*by, "_run"]
    first, last = F.ceil(F.col("_t0") / step) * step, F.floor(F.col("_t1") / step) * step
    kept = runs.groupBy(*own).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.count(F.lit(1)).alias("_n"))
    kept = kept.withColumn("start_ms", first).withColumn("stop_ms", last).filter((F.col("_n") >= least) & (F.col("stop_ms") - F.col("start_ms") >= (least - 1) * step))
    length = (F.col("stop_ms") - F.col("start_ms")) / step + 1
    w = over(by, ["_run"])
    kept = kept.withColumn("segment_id", (F.row_number().over(w) - 1).cast("int")).withColumn("start_index", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    kept = written(kept.withColumn("stop_index", (F.col("start_index") + length).cast("long")).drop("_t0", "_t1", "_n"), "session-segments")
    before = over(own, [time])
    lagged = runs.select(*own, F.col(time).alias("_t1"), F.lag(time).over(before).alias("_t0"), *values, *[F.lag(v).over(before).alias(f"_{v}") for v in values])
    low = F.when(F.col("_t0").isNull(), F.ceil(F.col("_t1") / step)).otherwise(F.floor(F.col("_t0") / step) + 1)
    high = F.floor(F.col("_t1") / step)
    rows = lagged.withColumn("_g", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))).withColumn("t_ms", F.col("_g") * step)
    share = (F.col("t_ms") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    there = F.col("_t0").isNull() | (F.col("t_ms") == F.col("_t1"))
    grid = [F.rint(F.when(there, F.col(v)).otherwise(F.col(f"_{v}") + (F.col(v) - F.col(f"_{v}")) * share)).alias(v) for v in values]
    off = F.coalesce(F.abs(F.col("_t1") - F.col("_t0") - step) > jitter, F.lit(False)).cast("int").alias("quality")
    place = (F.col("start_index") + (F.col("t_ms") - F.col("start_ms")) / step).cast("long").alias("frame_index")
    signal = rows.select(*own, "t_ms", *grid, off).join(kept.select(*own, "segment_id", "start_index", "start_ms"), own)
    return signal.select(*by, "segment_id", place, "t_ms", *values, "quality"), kept.drop("_run")


def mask_to_intervals(df: DataFrame, by: list[str], index: str, mask: Column) -> DataFrame:
    """Half-open [lo, hi) runs of consecutive indexes where the mask holds."""
    rows = df.filter(mask).select(*by, index).withColumn("island", F.col(index) - F.row_number().over(over(by, [index])))
    return rows.groupBy(*by, "island").agg(F.min(index).alias("lo"), (F.max(index) + 1).alias("hi")).drop("island")


def intervals_to_mask(intervals: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The indexes that the intervals cover."""
    return intervals.filter(F.col(hi) > F.col(lo)).select(*by, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("index"))


def run_lengths(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal labels: run number, label, length."""
    w = over(by, order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    rows = df.withColumn("run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(*by, "run").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("length"))


def run_string(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """The run labels of each group, one character each, in order."""
    w = over(by, order)
    rows = df.withColumn("before", F.lag(label).over(w)).filter(~F.col(label).eqNullSafe(F.col("before")) | F.col("before").isNull())
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(label).alias("x")))), lambda s: s["x"].cast("string")), "").alias("runs"))


def with_rising_edges(df: DataFrame, by: list[str], order: list[str], state: Column) -> DataFrame:
    """``bout_start`` (rising edge, a true first row included) and ``changed`` against the row before."""
    w = over(by, order)
    before = F.lag(state).over(w)
    return df.withColumn("bout_start", (state & ~F.coalesce(before, F.lit(False))).cast("int")).withColumn("changed", F.coalesce(state != before, F.lit(False)).cast("int"))


def boundary_targets(df: DataFrame, by: list[str], order: list[str], label: str, tolerance: int = 3) -> DataFrame:
    """``boundary`` is 1 on [p - tolerance + 1, p + tolerance] around each change after p."""
    w = over(by, order)
    after = F.lead(label).over(w)
    rows = df.withColumn("change_after", F.coalesce(after != F.col(label), F.lit(False)).cast("int"))
    return rows.withColumn("boundary", F.max("change_after").over(w.rowsBetween(-tolerance, tolerance - 1))).drop("change_after")


def chunk_index(runs: DataFrame, by: list[str], length: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """Overlapping chunks [start, stop) of each run; a later start needs more than the overlap left, a chunk two rows.

    ``supervised_chunks`` keeps those with a supervised row.
    """
    starts = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long")), lambda s: (s == 0) | (s + overlap < F.col(length)))
    rows = runs.select(*by, length, F.posexplode(starts).alias("chunk", "start")).withColumn("stop", F.least(F.col("start") + size, F.col(length)))
    return rows.filter(F.col("stop") - F.col("start") >= 2).select(*by, F.col("chunk").cast("long").alias("chunk"), "start", "stop")


def supervised_chunks(chunks: DataFrame, rows: DataFrame, by: list[str], place: str, mask: Column) -> DataFrame:
    """Chunks that hold a row under the mask (W16): a chunk is exploded into blocks of 1000 rows to meet those."""
    blocks = chunks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / 1000), F.floor((F.col("stop") - 1) / 1000))))
    marked = rows.filter(mask).select(*by, F.col(place).alias("_p"), F.floor(F.col(place) / 1000).alias("_b"))
    hit = blocks.join(marked, [*by, "_b"]).filter((F.col("_p") >= F.col("start")) & (F.col("_p") < F.col("stop"))).select(*by, "chunk").distinct()
    return chunks.join(hit, [*by, "chunk"], "left_semi")
