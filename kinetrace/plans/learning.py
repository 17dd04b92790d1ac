"""Queries over models and streams: rows only, tests hold their results."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..models import boosting, trees
from ..operators import features
from ..sources.scratch import shared_dir, written
from ..sources.tables import HOUR, POINTS, points, table
from ..streaming import causal
from .catalog import query
from .signal import MACHINE, SMOOTHED, postures, signal


@query("gbdt_score")
def gbdt_score(spark, sf):
    """Boosted trees on line items, threshold on held-out suppliers."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("cow_id"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"), ((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.04)).cast("int").alias("event_HIT"))
    task = boosting.train(d, "HIT", "event_HIT", "cow_id", ["l_quantity", "l_discount", "l_tax", "price"], boosting.Settings(trees=5, rate=0.3, depth=3))
    out = boosting.predict(d, [task])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prob_HIT", 6).alias("prob_HIT"), (F.col("prob_HIT") >= F.col("threshold_HIT")).alias("hit"))


def level_sql(k: int) -> str:
    """Tables of one level of the tree: sums per value, the best split per node, and the rows' nodes below."""
    values = " UNION ALL ".join(f"SELECT node, {f} AS f, x{f} AS v, g, h FROM n{k}" for f in range(3))
    return (
        f"h{k} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM ({values}) GROUP BY node, f, v), "
        f"c{k} AS (SELECT node, f, v, CAST(sum(g) OVER u AS DOUBLE) / 1048576 AS gl, CAST(sum(h) OVER u AS DOUBLE) / 1048576 AS hl, CAST(sum(g) OVER a AS DOUBLE) / 1048576 AS g, CAST(sum(h) OVER a AS DOUBLE) / 1048576 AS h FROM h{k} WINDOW u AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)), "
        f"s{k} AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM c{k} WHERE hl >= 5 AND h - hl >= 5), "
        f"b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS i FROM s{k} WHERE gain > 1e-6) WHERE i = 1), "
        f"n{k + 1} AS (SELECT r.* REPLACE (CASE WHEN b.node IS NULL THEN r.node WHEN CASE b.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END > b.v THEN 2 * r.node + 2 ELSE 2 * r.node + 1 END AS node) FROM n{k} r LEFT JOIN b{k} b ON b.node = r.node)"
    )


TREE_SQL = (
    "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2, l_quantity + 4 * l_linenumber > 36 AS y FROM lineitem), "
    "w AS (SELECT least(count(*) FILTER (NOT y) / count(*) FILTER (y), 1000.0) AS w FROM d), "
    "n0 AS (SELECT d.*, 0 AS node, CAST(round(CASE WHEN y THEN w * -0.5 ELSE 0.5 END * 1048576) AS BIGINT) AS g, CAST(round(CASE WHEN y THEN w ELSE 1 END * 0.25 * 1048576) AS BIGINT) AS h FROM d, w), "
    + ", ".join(level_sql(k) for k in range(3))
    + ", v AS (SELECT node, -0.3 * (CAST(sum(g) AS DOUBLE) / 1048576) / (CAST(sum(h) AS DOUBLE) / 1048576 + 1) AS v FROM n3 GROUP BY node) "
    "SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-v)), 9) AS prob FROM n3 JOIN v USING (node)"
)


@query("boosted_tree", TREE_SQL)
def boosted_tree(spark, sf):
    """One tree of second order with L2 = 1 and hessian sums of 5 per child over all line items, and its scores."""
    label = F.when(F.col("l_quantity") + 4 * F.col("l_linenumber") > 36, 2).otherwise(1).alias("state")
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(("l_quantity", "l_discount", "l_tax"))], label)
    no, yes = d.agg(F.count(F.when(F.col("state") == 1, 1)), F.count(F.when(F.col("state") == 2, 1))).first()
    forest = trees.fit_forests(d, ["x0", "x1", "x2"], ["state"], [min(no / yes, boosting.MOST_WEIGHT)], trees=1, rate=0.3, depth=3, subsample=1.0, columns=1.0, least_child=5.0, l2=1.0, bins=256, seed=1)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round(trees.probabilities(forest)[0], 9).alias("prob"))


#: Rows that a replay gives to one task of a micro-batch, all of which may be of one entity.
SLICE = 200_000


#: Of a replay's stream: state lies on the executors' disks, in bounded memory, where the default provider keeps all of it on their heaps.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def settings(spark, values: dict[str, str]):
    """The session with these settings, and afterwards with those that it had."""
    had = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(spark, df, name: str, plan, key: list[str], time: str):
    """Run a streaming plan over a table until it is used up; returns what it gave out, as a table in the warehouse.

    The table comes in slices of time, each a micro-batch of its own on the state that the last one left: as many as keep
    the largest entity's rows in one near SLICE. Its tasks are as many as keep a task's share near SLICE, so neither
    grows with the other, and Python, which is called per entity and slice, is not called more often as entities become
    more. The rows are dealt into slices once; a single slice is read as it stands.
    """
    base, tasks = shared_dir(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.withColumn("_at", F.unix_micros(time) if dict(df.dtypes)[time] == "timestamp" else F.col(time)).write.parquet(f"{base}/all")
    rows = spark.read.parquet(f"{base}/all")
    total, most = rows.groupBy(*key).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    n = max(-(-most // SLICE), 1)
    cuts = sorted({int(x) for x in rows.approxQuantile("_at", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    if cuts:
        place = sum((F.when(F.col("_at") >= c, 1).otherwise(0) for c in cuts), F.lit(0))  # rows without a time come last
        rows.withColumn("_slice", F.when(F.col("_at").isNull(), len(cuts)).otherwise(place)).drop("_at").write.partitionBy("_slice").parquet(f"{base}/slices")
        slices = spark.read.schema(StructType([*df.schema.fields, StructField("_slice", IntegerType())])).parquet(f"{base}/slices")
    for k in range(len(cuts) + 1):
        if cuts:
            slices.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in" if cuts else f"{base}/all")
        with settings(spark, STATE | {"spark.sql.shuffle.partitions": str(max(tasks, -(-total // (SLICE * n))))}):
            q = plan(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_sessions", f"WITH {POINTS}, g AS (SELECT *, sum(CASE WHEN d > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS d FROM p)), b AS (SELECT entity, min(t) AS start_ms, max(t) AS stop_ms, count(*) AS points FROM g GROUP BY entity, s) SELECT * FROM b WHERE stop_ms + {12 * HOUR} <= (SELECT max(t) FROM p) - {HOUR}")
def stream_sessions(spark, sf):
    """Session windows that the watermark has closed."""
    p = points(spark, sf).select("entity", F.timestamp_millis("t").alias("ts"))
    d = replay(spark, p, "sessions", lambda s: causal.sessions(s, ["entity"], "ts", "12 hours", "1 hour"), ["entity"], "ts")
    return d.select("entity", F.unix_millis("start_t").alias("start_ms"), F.unix_millis("stop_t").alias("stop_ms"), "points")


@query("stream_positive_runs", f"WITH {POINTS}, b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) > {12 * HOUR} THEN 1 ELSE 0 END AS b FROM p WHERE score >= 0.5), g AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b), r AS (SELECT entity, min(t) AS start_t, max(t) + {HOUR} AS end_t FROM g GROUP BY entity, g) SELECT r.* FROM r JOIN (SELECT entity, max(t) AS t FROM p GROUP BY 1) m USING (entity) WHERE m.t - (end_t - {HOUR}) > {12 * HOUR}")
def stream_positive_runs(spark, sf):
    """Intervals that a later point has closed, state kept per animal."""
    p = points(spark, sf).select("entity", "t", "score")
    return replay(spark, p, "runs", lambda s: causal.positive_runs(s, "entity", "t", "score", 0.5, 12 * HOUR, HOUR), ["entity"], "t")


@query("stream_state_machine", SMOOTHED + " SELECT entity, t, state_sm FROM q")
def stream_state_machine(spark, sf):
    """The posture state machine as a stateful stream; equals the batch form."""
    d = postures(spark, sf).drop("target")
    return replay(spark, d, "posture", lambda s: causal.state_machine(s, "entity", "t", MACHINE), ["entity"], "t")


LATE = f"(SELECT max(t) - {HOUR} FROM p)"


@query("stream_ordered_runs", f"WITH {POINTS}, q AS (SELECT * FROM p WHERE score >= 0.5 AND t <= {LATE}), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) > {12 * HOUR} THEN 1 ELSE 0 END AS b FROM q), g AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b), r AS (SELECT entity, min(t) AS start_t, max(t) AS last FROM g GROUP BY entity, g), c AS (SELECT r.*, (SELECT count(*) FROM p WHERE p.entity = r.entity AND p.t > r.last + {12 * HOUR} AND p.t <= {LATE}) AS later FROM r) SELECT entity, start_t, last + {HOUR} AS end_t FROM c WHERE later > 0 OR last + {12 * HOUR} < {LATE}")
def stream_ordered_runs(spark, sf):
    """Intervals from points that come up to an hour late; they end by the watermark, without a later point (2.10g)."""
    p = points(spark, sf).select("entity", "t", "score", (F.col("t") + F.pmod(F.xxhash64("id"), F.lit(HOUR))).alias("came"))
    return replay(spark, p, "ordered", lambda s: causal.ordered_runs(s, "entity", "t", "score", 0.5, 12 * HOUR, HOUR, "1 hour"), ["entity"], "came")


@query("stream_feature_bank")
def stream_feature_bank(spark, sf):
    """The causal features as a stream with the signal's last samples in state; equals the batch form (2.10a, 2.10f)."""
    d = written(signal(spark, sf), "stream-signal")
    known = written(features.references(d, "cache_key", "segment_id", "frame_index", True), "stream-references")  # read by every micro-batch
    return replay(spark, d, "features", lambda s: causal.feature_bank(s, known), ["cache_key", "segment_id"], "frame_index")
