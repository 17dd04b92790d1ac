"""Session caches of the older layout: one array file per session with a JSON document beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recordings import RAW_CHANNELS

CHANNEL_MODES = {"raw9": RAW_CHANNELS, "accgyro6": RAW_CHANNELS[:6]}


def channels(signal: DataFrame, mode: str = "raw9") -> DataFrame:
    """The signal with the channels of a mode only."""
    if mode not in CHANNEL_MODES:
        raise ValueError(f"unknown channel mode {mode}")
    return signal.select(*[c for c in signal.columns if c not in RAW_CHANNELS or c in CHANNEL_MODES[mode]])


def checked_key(key: str) -> str:
    """A cache key that stays inside its folder."""
    if not key or key in (".", "..") or any(c in key for c in "/\\\0"):
        raise ValueError(f"not a cache key: {key!r}")
    return key


def read_arrays(spark: SparkSession, folder: str, name: str = "signal.npy") -> DataFrame:
    """cache_key, frame_index and the channels (double) of every array below the folder's session folders.

    Works for counts (16-bit) and for the older physical floats of nine or more columns; the first nine are read. A file
    is one task's work, as it has no inner split; segments come from its JSON document (``read_documents``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -2).alias("cache_key"), "content")

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                for k in range(0, len(a), 100_000):
                    part = a[k : k + 100_000, :9].astype("f8")
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(np.arange(k, k + len(part))), *[pa.array(np.ascontiguousarray(part[:, i])) for i in range(9)]], names=["cache_key", "frame_index", *RAW_CHANNELS])

    return files.mapInArrow(rows, "cache_key string, frame_index long, " + ", ".join(f"{c} double" for c in RAW_CHANNELS))


def read_documents(spark: SparkSession, folder: str, name: str = "metadata.json") -> DataFrame:
    """One row per session: cache_key, schema_version, cow_id, and its segments; one whole-file segment where none is given."""
    kind = "schema_version int, cow_id string, frames long, segments array<struct<segment_id:int,start_index:long,stop_index:long,start_ms:long,stop_ms:long>>"
    d = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    d = d.select(F.element_at(F.split("path", "/"), -2).alias("cache_key"), F.from_json(F.decode("content", "UTF-8"), kind).alias("d")).select("cache_key", "d.*")
    whole = F.array(F.struct(F.lit(0).alias("segment_id"), F.lit(0).cast("long").alias("start_index"), F.col("frames").alias("stop_index"), F.lit(0).cast("long").alias("start_ms"), (F.col("frames") * 20).alias("stop_ms")))
    clipped = F.filter(F.coalesce("segments", whole), lambda s: s["start_index"] < F.coalesce(F.col("frames"), s["stop_index"]))
    return d.withColumn("segments", clipped)
