"""What several operators share: table access, the shared folder, bounded broadcasts, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: More rows, or more bytes of strings, than this are never broadcast; the plain shuffle join takes over.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str) -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="kinetrace-")
        spark.conf.set("spark.checkpoint.dir", top)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends in files that outlive executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast only after counting rows and the bytes of strings: a larger side stays a shuffle join, which AQE splits on skew."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    weight = sum(texts, F.lit(0)).cast("long").alias("weight")
    n, size = df.select(weight).limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= BROADCAST_BYTES else df


def file_system(uri: str):
    """The file system and path of a URI, for workers that write files of their own format."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """``write(stream)`` to a name of this attempt, then move: a retried or doubled task leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt, compression=None) as out:
        write(out)
    fs.move(attempt, path)
