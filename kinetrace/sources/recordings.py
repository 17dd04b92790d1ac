"""Raw recordings: JSON documents with packed frames (S01 - S04), and the session cache as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intervals import points_in
from .scratch import written

# Fixed layout: little-endian u4 elapsed_ms and nine i2.
RAW_CHANNELS = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_raw_x", "mag_raw_y", "mag_raw_z")
FRAME, FRAME_BYTES = np.dtype([("ms", "<u4"), ("v", "<i2", (9,))]), 22
LEAST_FRAMES, LEAST_SCORE, SCORED_FRAMES, PLAUSIBLE_RUN = 10, 0.80, 8000, 8
SESSION_KIND = T.StructType([T.StructField(n, T.StringType()) for n in ("imu", "device", "create_time")])


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per document: path, device, create_time_ms, payload, error. A byte-order mark and white space in the
    base64 text are fine; a malformed document is a row with an error, not a failed job (S01, Q8)."""
    raw = spark.read.format("binaryFile").load(paths).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("doc"))
    d = raw.withColumn("d", F.from_json("doc", SESSION_KIND))
    payload = F.try_to_binary(F.regexp_replace("d.imu", r"\s", ""), F.lit("base64"))
    error = F.when(F.coalesce(F.length("d.imu"), F.lit(0)) == 0, "missing imu field").when(payload.isNull(), "imu is not base64")
    return d.select("path", F.coalesce("d.device", F.lit("")).alias("device"), F.expr("try_cast(d.create_time AS BIGINT)").alias("create_time_ms"), payload.alias("payload"), error.alias("error"))


def phase_score(payload: bytes, offset: int) -> float:
    """How much the frames at this byte phase look like a 50 Hz clock."""
    count = (len(payload) - offset) // FRAME_BYTES
    if count < LEAST_FRAMES:
        return -np.inf
    ms = np.frombuffer(payload, FRAME, min(count, SCORED_FRAMES), offset)["ms"].astype("i8")
    dt = np.diff(ms)
    ahead = dt[dt > 0]
    cadence = np.exp(-abs(float(np.median(ahead)) - 20) / 20) if len(ahead) else 0.0
    return float(0.55 * ((dt >= 10) & (dt <= 40)).mean() + 0.25 * (dt > 0).mean() + 0.10 * ((dt >= 1) & (dt <= 1000)).mean() + 0.10 * cadence)


def first_plausible(ms: np.ndarray, run: int = PLAUSIBLE_RUN) -> int:
    """First frame that starts so many plausible steps in a row, else 0."""
    if len(ms) <= run:
        return 0
    good = np.concatenate([[0], np.cumsum((np.diff(ms) >= 5) & (np.diff(ms) <= 100))])
    starts = np.nonzero(good[run:] - good[:-run] == run)[0]
    return int(starts[0]) if len(starts) else 0


def decode(payload: bytes | None) -> dict:
    """ms, values and diagnostics of one payload, or an error."""
    blank = {"ms": None, "values": None, "frame_offset": None, "dropped_prefix": None, "dropped_trailing": None, "score": None}
    if payload is None or len(payload) < FRAME_BYTES * LEAST_FRAMES:
        return blank | {"error": "payload too short"}
    scores = [phase_score(payload, k) for k in range(FRAME_BYTES)]
    best = int(np.argmax(scores))
    if not scores[best] >= LEAST_SCORE:
        return blank | {"error": "no credible frame phase"}
    count, trailing = divmod(len(payload) - best, FRAME_BYTES)
    f = np.frombuffer(payload, FRAME, count, best)
    lead = first_plausible(f["ms"].astype("i8"))
    f = f[lead:]
    return {"ms": f["ms"].astype("i8"), "values": f["v"], "frame_offset": best, "dropped_prefix": best + lead * FRAME_BYTES, "dropped_trailing": trailing, "score": scores[best], "error": None}


DIAGNOSTICS = "frame_offset int, dropped_prefix int, dropped_trailing int, score double, frames long, error string"


def decode_frames(df: DataFrame, key: str, payload: str = "payload", once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, diagnostics): one row per frame with its place, elapsed_ms and raw channels; one row per payload.

    With ``once`` both come from one pass over the payloads, whose rows are written. A worker holds one decoded payload.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, payload)
    frame_kinds, note_kinds = f"{key} {kind}, place long, elapsed_ms long, " + ", ".join(f"{c} short" for c in RAW_CHANNELS), f"{key} {kind}, {DIAGNOSTICS}"

    def both(batches):
        import pyarrow as pa

        note = {"frame_offset": pa.int32(), "dropped_prefix": pa.int32(), "dropped_trailing": pa.int32(), "score": pa.float64(), "frames": pa.int64(), "error": pa.string()}
        own = {"place": pa.int64(), "elapsed_ms": pa.int64(), **dict.fromkeys(RAW_CHANNELS, pa.int16())}
        for batch in batches:
            for k, p in zip(batch.column(0), batch.column(1), strict=True):
                d = decode(p.as_py())
                n = 0 if d["ms"] is None else len(d["ms"])
                if n:
                    found = [np.arange(n), d["ms"], *np.ascontiguousarray(d["values"].T)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, k.type), *map(pa.array, found), *[pa.nulls(n, t) for t in note.values()]], names=[key, *own, *note])
                told = [pa.array([n if c == "frames" else d[c]], t) for c, t in note.items()]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), *[pa.nulls(1, t) for t in own.values()], *told], names=[key, *own, *note])

    if once:
        d = written(rows.mapInArrow(both, f"{frame_kinds}, {DIAGNOSTICS}"), "decoded")
        return tuple(d.filter(keep).select(key, *[c.split()[0] for c in kinds.split(", ")[1:]]) for keep, kinds in (("place IS NOT NULL", frame_kinds), ("place IS NULL", note_kinds)))

    def frames(batches):
        import pyarrow as pa

        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = decode(p.as_py())
                if d["ms"] is not None and len(d["ms"]):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(d["ms"]), batch.schema.field(0).type), pa.array(np.arange(len(d["ms"]))), pa.array(d["ms"]), *[pa.array(np.ascontiguousarray(d["values"][:, i])) for i in range(9)]], names=[key, "place", "elapsed_ms", *RAW_CHANNELS])

    def notes(batches):
        import pyarrow as pa

        for batch in batches:
            found = [{**d, "ms": None, "values": None, "frames": 0 if d["ms"] is None else len(d["ms"])} for d in (decode(p.as_py()) for p in batch.column(1))]
            cols = [pa.array([d[c] for d in found], t) for c, t in (("frame_offset", pa.int32()), ("dropped_prefix", pa.int32()), ("dropped_trailing", pa.int32()), ("score", pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([d["frames"] for d in found], pa.int64()), pa.array([d["error"] for d in found], pa.string())], names=[key, "frame_offset", "dropped_prefix", "dropped_trailing", "score", "frames", "error"])

    return rows.mapInArrow(frames, frame_kinds), rows.mapInArrow(notes, note_kinds)


def packed(ms: Column, values: list[Column]) -> Column:
    """One 22-byte frame as binary, little-endian: the inverse of the decoder, for fixtures and exports."""
    low = lambda x, n: F.concat(*[F.substring(F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 8 * n))), 2 * n, "0"), 2 * (n - i) - 1, 2) for i in range(n)])
    return F.unhex(F.concat(low(ms, 4), *[low(v, 2) for v in values]))


def joined(frames: Column) -> Column:
    """An array of binaries as one, in time linear in its length."""
    return F.unhex(F.array_join(F.transform(frames, F.hex), ""))


def write_cache(signal: DataFrame, path: str, cow: str = "cow_id") -> None:
    """Counts as shorts, partitioned by animal; refuses to overwrite and any value that is not a finite 16-bit count."""
    out = signal
    for c in RAW_CHANNELS:
        x = F.col(c).cast("double")
        fits = x.isNotNull() & ~F.isnan(x) & F.rint(x).between(-32768, 32767)
        out = out.withColumn(c, F.when(fits, F.rint(x).cast("short")).otherwise(F.raise_error(F.lit(f"{c} is not a finite 16-bit count")).cast("short")))
    out.write.mode("errorifexists").partitionBy(cow).parquet(path)


def read_cache(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The cached signal, or a slice by frame index, which reaches the scan as a pushed filter."""
    d = spark.read.parquet(path)
    if start is not None:
        d = d.filter(F.col("frame_index") >= start)
    return d.filter(F.col("frame_index") < stop) if stop is not None else d


def frame_time(start_ms: Column, index: Column, start_index: Column, step: int = 20) -> Column:
    """Time of a frame; it is never stored."""
    return start_ms + step * (index - start_index)


def with_quality(frames: DataFrame, flagged: DataFrame, key: str = "cache_key", index: str = "frame_index") -> DataFrame:
    """``quality`` 0/1 from sparse half-open index intervals lo, hi."""
    hit = points_in(frames.select(key, index), flagged, [key], index, "lo", "hi", 10_000).select(key, index).distinct().withColumn("quality", F.lit(1))
    return frames.join(hit, [key, index], "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
