"""The folder that driver and executors share, for tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More rows, or more bytes of strings, than this are never broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session that names none gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="kinetrace-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """The table, written once (with the writer's ``options``) and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether rows and the bytes of strings are within what may be broadcast; reads no more rows than that."""
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0)).cast("long")
    n, size = df.select(weight.alias("w")).limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= most and size <= BROADCAST_BYTES


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only after it is counted; else a shuffle join that AQE splits."""
    return F.broadcast(df) if is_small(df, most) else df
