"""Table readers and sinks with their sidecars."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, else CSV (gzip by its name) with a header; a byte-order mark is dropped from the first name."""
    try:
        return spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError):  # no footer to read: not Parquet
        d = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
        return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def optional_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException:
        return None


def write_table(df: DataFrame, path: str, manifest: dict | None = None, format: str = "parquet", by: list[str] | None = None) -> None:
    """A table, refusing to overwrite, with an optional one-row JSON manifest beside it."""
    writer = df.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", "true").format(format).save(path)
    if manifest is not None:
        write_json(df.sparkSession, manifest, f"{path.rstrip('/')}.manifest")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON sidecar through Spark's writer, so that it lands in the same store as the table."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def sample_ids(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """SMP-0000001 ids in order (S11): numbers run within each group, on from the groups before it, so that no
    window holds the whole table; only the group counts are summed in one place."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).join(start, by)
    return d.withColumn("sample_id", F.format_string("SMP-%07d", F.col("_r") + F.col("_start"))).drop("_r", "_start")


def markdown(rows: list[dict]) -> str:
    """A small report table."""
    if not rows:
        return ""
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)])
