"""Readers of the driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored points: entity, id, t (ms), score in [0, 1), code, day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"), (F.col("value") / (F.col("value") + 35.0)).alias("score"), F.col("event_type").alias("code"), F.to_date("ts").alias("day"))


#: The same in SQL.
POINTS = "p AS (SELECT user_id AS entity, event_id AS id, epoch_us(ts) // 1000 AS t, value / (value + 35.0) AS score, event_type AS code, CAST(ts AS DATE) AS day FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a dense series: entity (supplier), k0 to k3 (a total order), x."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("k0"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


SAMPLES = "s AS (SELECT l_suppkey AS entity, l_shipdate AS k0, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_quantity AS x, l_extendedprice AS y FROM lineitem)"
ORDER = ["k0", "k1", "k2", "k3", "y"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals: entity (customer), id, s, e in days; the length depends on the price."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), day.alias("s"), (day + 1 + F.floor(F.col("o_totalprice") / 5000)).cast("long").alias("e"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


SPANS = "o AS (SELECT o_custkey AS entity, o_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 1 + CAST(floor(o_totalprice / 5000) AS BIGINT) AS e, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
