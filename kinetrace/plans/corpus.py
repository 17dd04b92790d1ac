"""Queries over labels, splits, reports and review queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as vocab
from ..operators import labels, mining, reports, splits
from ..operators import timeline as tl
from ..sources.tables import HOUR, POINTS, SAMPLES, SPANS, points, samples, spans, table
from .catalog import query
from .events import WINDOWS, _windows

STATE_CODES, EVENT_CODES = ("F", "P"), ("1-URGENT", "2-HIGH")
ANNOTATED = f"""{POINTS}, {SPANS.replace('o AS', 'o0 AS')}, a0 AS (SELECT entity % 150 AS entity, status, priority, 1704067200000 + (s % 30) * {24 * HOUR} AS start_t, 1704067200000 + (s % 30) * {24 * HOUR} + (e - s) * {HOUR} AS end_t FROM o0),
a AS (SELECT entity, status AS code, start_t, end_t FROM a0 WHERE status IN ('F', 'P') UNION ALL SELECT entity, priority, start_t, end_t FROM a0),
g AS (SELECT p.entity, p.t, min(CASE a.code WHEN 'F' THEN 0 WHEN 'P' THEN 1 END) AS lo, max(CASE a.code WHEN 'F' THEN 0 WHEN 'P' THEN 1 END) AS hi, max((a.code = '1-URGENT')::INT) AS u, max((a.code = '2-HIGH')::INT) AS h FROM p JOIN a ON a.entity = p.entity AND t >= start_t AND t < end_t WHERE a.code IN ('F', 'P', '1-URGENT', '2-HIGH') GROUP BY ALL),
l AS (SELECT p.entity, p.t, coalesce(lo, -1) AS body_target, coalesce(lo <> hi, false) AS state_conflict, coalesce(u, 0) AS e1, coalesce(h, 0) AS e2 FROM p LEFT JOIN g USING (entity, t))"""


def annotations(spark, sf):
    at = F.lit(1704067200000) + (F.col("s") % 30) * 24 * HOUR
    a = spans(spark, sf).select((F.col("entity") % 150).alias("entity"), "status", "priority", at.alias("start_t"), (at + (F.col("e") - F.col("s")) * HOUR).alias("end_t"))
    return a.filter(F.col("status").isin("F", "P")).select("entity", F.col("status").alias("code"), "start_t", "end_t").union(a.select("entity", "priority", "start_t", "end_t"))


def labelled(spark, sf):
    p = points(spark, sf).select("entity", "t")
    return labels.label_points(p, annotations(spark, sf), ["entity"], "t", 24 * HOUR, STATE_CODES, EVENT_CODES, strict=False)


@query("label_points", f"WITH {ANNOTATED} SELECT entity, t, body_target, state_conflict, e1 AS urgent, e2 AS high FROM l")
def label_points(spark, sf):
    return labelled(spark, sf).select("entity", "t", "body_target", "state_conflict", F.col("event_1-URGENT").alias("urgent"), F.col("event_2-HIGH").alias("high"))


COVERED = """c AS (SELECT entity, start_t, end_t, CASE WHEN id % 10 = 0 THEN 'ALL' WHEN id % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS code, id % 3 <> 0 AS reviewed FROM o)"""


@query("coverage_mask_join", f"WITH {POINTS}, {WINDOWS}, {COVERED} SELECT entity, t, (EXISTS (SELECT 1 FROM c WHERE c.entity = p.entity AND reviewed AND code IN ('ALL', '1-URGENT') AND t >= start_t AND t < end_t))::INT AS urgent, (EXISTS (SELECT 1 FROM c WHERE c.entity = p.entity AND reviewed AND code IN ('ALL', '2-HIGH') AND t >= start_t AND t < end_t))::INT AS high FROM p")
def coverage_mask_join(spark, sf):
    code = F.when(F.col("id") % 10 == 0, "ALL").when(F.col("id") % 2 == 0, "1-URGENT").otherwise("2-HIGH")
    c = _windows(spark, sf).select("entity", "start_t", "end_t", code.alias("event_code"), F.when(F.col("id") % 3 != 0, " Yes ").otherwise("0").alias("exhaustive_reviewed"))
    d = labels.review_masks(points(spark, sf).select("entity", "t"), c, ["entity"], "t", 24 * HOUR, EVENT_CODES)
    return d.select("entity", "t", F.col("mask_1-URGENT").alias("urgent"), F.col("mask_2-HIGH").alias("high"))


def _policy(spark, sf, name):
    event, mask = labels.tail_policy(F.col("event_2-HIGH"), (F.col("body_target") >= 0).cast("int"), F.col("event_1-URGENT"), name)
    return labelled(spark, sf).select("entity", "t", event.alias("event"), mask.alias("mask"))


@query("policy_derive", f"WITH {ANNOTATED} SELECT entity, t, greatest(e2, e1) AS event, greatest((body_target >= 0)::INT, e1) AS mask FROM l")
def policy_derive(spark, sf):
    return _policy(spark, sf, "derive")


@query("policy_exclude", f"WITH {ANNOTATED} SELECT entity, t, e2 AS event, CASE WHEN e1 > 0 AND e2 = 0 THEN 0 ELSE (body_target >= 0)::INT END AS mask FROM l")
def policy_exclude(spark, sf):
    return _policy(spark, sf, "exclude")


@query("supervised_rows", f"WITH {ANNOTATED} SELECT entity, t, body_target, greatest((body_target >= 0)::INT, e1) AS m1, greatest((body_target >= 0)::INT, e2) AS m2 FROM l WHERE body_target >= 0 OR e1 > 0 OR e2 > 0")
def supervised_rows(spark, sf):
    d = labels.supervised(labels.proxy_masks(labelled(spark, sf), EVENT_CODES), EVENT_CODES)
    return d.select("entity", "t", "body_target", F.col("mask_1-URGENT").alias("m1"), F.col("mask_2-HIGH").alias("m2"))


@query("coverage_summary", f"WITH {ANNOTATED} SELECT 'urgent' AS code, round(count(*) FILTER (body_target >= 0 OR e1 > 0) * 0.5 / 3600, 9) AS hours FROM l UNION ALL SELECT 'high', round(count(*) FILTER (body_target >= 0 OR e2 > 0) * 0.5 / 3600, 9) FROM l")
def coverage_summary(spark, sf):
    d = labels.proxy_masks(labelled(spark, sf), EVENT_CODES)
    return reports.mask_hours(d, {"urgent": F.col("mask_1-URGENT") == 1, "high": F.col("mask_2-HIGH") == 1}).select("code", F.round("hours", 9).alias("hours"))


@query("hierarchical_targets", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber % 5 = 4 THEN -1 WHEN l_linenumber % 5 = 1 THEN 1 ELSE 0 END AS posture, CASE WHEN l_linenumber % 5 = 4 THEN -1 ELSE (l_linenumber % 5 = 2)::INT END AS walking FROM lineitem")
def hierarchical_targets(spark, sf):
    body = F.when(F.col("l_linenumber") % 5 == 4, -1).otherwise(F.col("l_linenumber") % 5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", vocab.posture(body).alias("posture"), vocab.walking(body).alias("walking"))


@query("ring_positions", "SELECT c_custkey, coalesce(CASE c_custkey % 6 WHEN 0 THEN 'root' WHEN 1 THEN 'mid' WHEN 2 THEN 'tip' END, 'unknown') AS position FROM customer")
def ring_positions(spark, sf):
    """Positions as they are typed: in any case, with space around, missing, or unknown to the vocabulary."""
    typed = F.element_at(F.array(*map(F.lit, ("ROOT ", " Mid", "tip", "Unknown", "neck", None))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", vocab.ring_position(typed).alias("position"))


@query("cache_key", "SELECT c_custkey, trim(regexp_replace(c_name, '[^0-9A-Za-z]+', '_', 'g'), '_') || '_' || sha256(c_name)[1:10] AS cache_key, c_name || '|' || c_custkey AS session_key FROM customer")
def cache_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", vocab.cache_key(F.col("c_name")).alias("cache_key"), vocab.session_key(F.col("c_name"), F.col("c_custkey").cast("string")).alias("session_key"))


@query("calibration_join", "SELECT s_suppkey, n_name, coalesce(s_acctbal > 0, true) AS eligible, CASE WHEN n_nationkey IS NULL THEN 'failed' WHEN coalesce(s_acctbal > 0, true) THEN 'included' ELSE 'excluded' END AS status FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON s_nationkey = n_nationkey")
def calibration_join(spark, sf):
    """Sessions against their manifest; a miss is a failure row, an ineligible one is excluded."""
    n = table(spark, sf, "nation").filter("n_nationkey % 4 <> 0")
    d = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # nations are 25 rows at every scale
    ok = F.coalesce(F.col("s_acctbal") > 0, F.lit(True))
    return d.select("s_suppkey", "n_name", ok.alias("eligible"), F.when(F.col("n_nationkey").isNull(), "failed").when(ok, "included").otherwise("excluded").alias("status"))


@query("annotation_audit", f"WITH {SPANS} SELECT priority AS code, count(*) AS annotations, count(DISTINCT entity) AS animals, count(DISTINCT id % 977) AS sessions, round(avg((e - s) * 1.5), 6) AS mean_s, quantile_cont((e - s) * 1.5, 0.5)::DOUBLE AS median_s, max((e - s) * 1.5)::DOUBLE AS max_s, round(sum((e - s) * 1.5) / 60, 6)::DOUBLE AS minutes FROM o GROUP BY 1")
def annotation_audit(spark, sf):
    d = spans(spark, sf).withColumn("session", F.col("id") % 977).withColumnRenamed("priority", "code")
    a = reports.annotation_audit(d, "code", "entity", "session", "s", "e", 1.5)
    return a.withColumn("mean_s", F.round("mean_s", 6)).withColumn("minutes", F.round("minutes", 6))


@query("evaluability", "WITH v AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('never')) v(code)), a AS (SELECT o_orderpriority AS code, count(*) AS annotations, count(DISTINCT o_custkey) AS animals FROM orders GROUP BY 1) SELECT code, coalesce(annotations, 0) AS annotations, coalesce(animals, 0) AS animals, coalesce(annotations, 0) >= 10 AND coalesce(animals, 0) >= 3 AS evaluable FROM v LEFT JOIN a USING (code)")
def evaluability(spark, sf):
    v = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("never",)], "code string")
    a = spans(spark, sf).groupBy(F.col("priority").alias("code")).agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("entity").alias("animals"))
    return reports.evaluability(v, a, "code")


@query("cow_balance", "WITH n AS (SELECT o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY n DESC, entity ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS so_far FROM n) SELECT count(*) AS animals, round(max(share), 9) AS largest_share, count(*) FILTER (so_far < 0.8) + 1 AS animals_for_80, round(1 / sum(share * share), 6) AS effective_animals FROM s")
def cow_balance(spark, sf):
    b = reports.balance(table(spark, sf, "orders").withColumnRenamed("o_custkey", "entity"), "entity")
    return b.withColumn("largest_share", F.round("largest_share", 9)).withColumn("effective_animals", F.round("effective_animals", 6))


SEGMENTED = f"{POINTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS step FROM p), q AS (SELECT *, sum(CASE WHEN step > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS segment FROM g), b AS (SELECT entity, segment, min(t) AS start_t, max(t) AS stop_t FROM q GROUP BY ALL)"


def _bounds(spark, sf):
    return tl.segment_bounds(tl.with_segments(points(spark, sf), ["entity"], "t", 12 * HOUR), ["entity"], "t")


@query("segment_report", f"WITH {SEGMENTED}, s AS (SELECT (stop_t - start_t) / 1000.0 AS s FROM b) SELECT count(*) AS segments, min(s) AS min_s, quantile_cont(s, 0.5) AS median_s, round(avg(s), 6) AS mean_s, max(s) AS max_s FROM s")
def segment_report(spark, sf):
    return reports.segments(_bounds(spark, sf), (F.col("stop_t") - F.col("start_t")) / 1000.0).withColumn("mean_s", F.round("mean_s", 6))


@query("segment_histogram", f"WITH {SEGMENTED}, n AS (SELECT entity, count(*) AS segments FROM b GROUP BY 1) SELECT segments, count(*) AS sessions FROM n GROUP BY 1")
def segment_histogram(spark, sf):
    return reports.segment_histogram(_bounds(spark, sf), F.col("entity"))


@query("coverage_report", f"WITH {SPANS} SELECT priority AS code, sum((e - s) * 0.5)::DOUBLE AS reviewed_hours, count(DISTINCT (entity, status)) AS sessions, CASE WHEN sum(e - s) > 0 THEN 'claimable' ELSE 'not_claimable' END AS verdict FROM o WHERE status <> 'P' GROUP BY 1")
def coverage_report(spark, sf):
    d = spans(spark, sf).withColumnRenamed("priority", "code")
    return reports.coverage(d, "code", ["entity", "status"], F.col("status") != "P", (F.col("e") - F.col("s")) * 0.5)


FOLDS = """w AS (SELECT DISTINCT s_suppkey AS cow FROM supplier), n AS (SELECT cow, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('20260819:' || cow), cow) - 1 AS i FROM w),
b AS (SELECT cow, i, n, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END + 1 AS block FROM n),
x AS (SELECT unnest(range(1, 6)) AS fold, cow, block FROM b),
r AS (SELECT fold, cow, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY cow) <= greatest(1, round_even(count(*) OVER (PARTITION BY fold) * 0.2, 0)) THEN 'validation' ELSE 'train' END AS role FROM x WHERE fold <> block
      UNION ALL SELECT fold, cow, 'test' FROM x WHERE fold = block)"""


def folds(spark, sf):
    return splits.grouped_folds(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "cow"), "cow", 5)


@query("grouped_folds", f"WITH {FOLDS} SELECT * FROM r")
def grouped_folds(spark, sf):
    return folds(spark, sf)


@query("split_leak_check", f"WITH {FOLDS}, l AS (SELECT * FROM r UNION ALL SELECT fold, cow, 'train' FROM r WHERE role = 'test' AND cow % 3 = 0) SELECT fold, cow, count(DISTINCT role) AS roles FROM l GROUP BY ALL HAVING count(DISTINCT role) > 1")
def split_leak_check(spark, sf):
    """A manifest in which some tested animals are trained on too."""
    f = folds(spark, sf)
    return splits.leaks(f.unionByName(f.filter("role = 'test' AND cow % 3 = 0").withColumn("role", F.lit("train"))), "fold", "cow", "role")


@query("fold_report", f"WITH {FOLDS}, z AS (SELECT l_suppkey AS cow, count(*) AS n FROM lineitem GROUP BY 1) SELECT fold, count(*) FILTER (role = 'train') AS train_cows, count(*) FILTER (role = 'validation') AS validation_cows, count(*) FILTER (role = 'test') AS test_cows, coalesce(sum(n) FILTER (role = 'test'), 0)::BIGINT AS test_samples, coalesce(sum(n) FILTER (role = 'test'), 0) >= 1000 AS usable FROM r LEFT JOIN z USING (cow) GROUP BY fold")
def fold_report(spark, sf):
    return reports.fold_report(folds(spark, sf), samples(spark, sf).groupBy(F.col("entity").alias("cow")).agg(F.count(F.lit(1)).alias("n")), "cow")


@query("holdout_cows", "WITH w AS (SELECT DISTINCT s_suppkey AS cow FROM supplier) SELECT cow FROM w ORDER BY md5('20260819:' || cow), cow LIMIT (SELECT greatest(1, least(count(*) - 1, round_even(count(*) * 0.2, 0)))::BIGINT FROM w)")
def holdout_cows(spark, sf):
    return splits.holdout(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "cow"), "cow")


@query("channel_statistics", f"WITH {SAMPLES}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k0, k1, k2, k3, y) <= 200000) SELECT round(avg(x), 6) AS x_mean, round(avg(y), 4) AS y_mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)), 6) AS x_std, round(sqrt(greatest(avg(y * y) - avg(y) * avg(y), 1e-8)), 3) AS y_std FROM f")
def channel_statistics(spark, sf):
    d = reports.channel_statistics(samples(spark, sf), ["entity"], ["k0", "k1", "k2", "k3", "y"], ["x", "y"])
    return d.select(F.round("x_mean", 6).alias("x_mean"), F.round("y_mean", 4).alias("y_mean"), F.round("x_std", 6).alias("x_std"), F.round("y_std", 3).alias("y_std"))


@query("normalise", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem WHERE l_linestatus = 'F')) / greatest((SELECT stddev_pop(l_quantity) FROM lineitem WHERE l_linestatus = 'F'), 1e-6), 6) AS z FROM lineitem")
def normalise(spark, sf):
    """z values by the training rows' mean and deviation, a one-row broadcast."""
    li = table(spark, sf, "lineitem")
    s = li.filter("l_linestatus = 'F'").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("sd"))
    return li.join(F.broadcast(s), F.lit(True)).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(reports.normalised(F.col("l_quantity"), F.col("m"), F.col("sd")), 6).alias("z"))


@query("pos_weight", "WITH n AS (SELECT l_returnflag AS code, count(*) FILTER (l_tax = 0.08) AS positives, count(*) FILTER (l_tax <> 0.08) AS negatives FROM lineitem GROUP BY 1) SELECT code, positives, negatives, round(negatives / nullif(positives, 0), 9) AS ratio, round(coalesce(least(greatest(negatives / nullif(positives, 0), 1), 20), 1), 9) AS weight FROM n")
def pos_weight(spark, sf):
    d = reports.positive_weight(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "code"), ["code"], F.col("l_tax") == 0.08)
    return d.withColumn("ratio", F.round("ratio", 9)).withColumn("weight", F.round("weight", 9))


@query("storage_plan", "SELECT n_nationkey AS cows, n_nationkey * 7 * 24 * 3600 * 50 AS frames, round(n_nationkey * 7 * 24 * 3600 * 50 * 52 / 1073741824.0, 6) AS gib_schema1, round(n_nationkey * 7 * 24 * 3600 * 50 * 18 / 1073741824.0, 6) AS gib_schema2, round(52.0 / 18, 6) AS ratio FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)")
def storage_plan(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("cows"))
    d = n.select("cows", *reports.storage(F.col("cows"), F.lit(7)))
    return d.select("cows", "frames", *[F.round(c, 6).alias(c) for c in ("gib_schema1", "gib_schema2", "ratio")])


@query("verify_checks", """
WITH c AS (SELECT 'duplicate_line_keys' AS "check", 'warning' AS severity, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n
UNION ALL SELECT 'non_positive_price', 'error', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 0) UNION ALL SELECT 'unknown_status', 'error', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
UNION ALL SELECT 'orphan_lines', 'error', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)))
SELECT *, CASE WHEN (SELECT bool_or(severity = 'error' AND n > 0) FROM c) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c""")
def verify_checks(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    known = spark.createDataFrame([("O",), ("F",)], "o_orderstatus string")
    return reports.verify([
        reports.check("duplicate_line_keys", "warning", reports.duplicates(li, ["l_orderkey", "l_linenumber"])), reports.check("non_positive_price", "error", o.filter("NOT o_totalprice > 0")),
        reports.check("unknown_status", "error", o.join(F.broadcast(known), "o_orderstatus", "left_anti")), reports.check("orphan_lines", "error", li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
    ])


@query("keep_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) = 1")
def keep_last(spark, sf):
    return reports.keep_last(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("rate_capped_topk", f"WITH {POINTS} SELECT entity, id FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, id) <= greatest(1, round_even(0.25 * 24 * 2.0, 0))")
def rate_capped_topk(spark, sf):
    return mining.capped(points(spark, sf), ["entity"], "score", mining.daily_cap(F.lit(0.25)), ["id"]).select("entity", "id")


@query("diverse_topk", f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, id) AS round FROM p) SELECT entity, id FROM r ORDER BY round, score DESC, id LIMIT 200")
def diverse_topk(spark, sf):
    return mining.diverse(points(spark, sf), "entity", "score", 200, ["id"]).select("entity", "id")


@query("session_cut", f"WITH {POINTS} SELECT entity, round(quantile_cont(score, 0.995), 9) AS cut FROM p GROUP BY 1 HAVING count(*) >= 3")
def session_cut(spark, sf):
    return mining.session_cut(points(spark, sf), ["entity"], "score").withColumn("cut", F.round("cut", 9))


@query("random_control", f"WITH {POINTS} SELECT entity, id FROM p ORDER BY md5('7:' || id), id LIMIT 100")
def random_control(spark, sf):
    return points(spark, sf).orderBy(splits.shuffled(F.col("id"), 7), "id").limit(100).select("entity", "id")


@query("review_queue", f"""
WITH {POINTS}, c AS (SELECT entity, quantile_cont(score, 0.9) AS cut FROM p GROUP BY 1 HAVING count(*) >= 3), h AS (SELECT p.*, cut, score >= cut AS hot FROM p JOIN c USING (entity)),
l AS (SELECT *, last_value(CASE WHEN hot THEN t END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h),
n AS (SELECT *, sum(CASE WHEN hot AND (prev IS NULL OR t - prev > {12 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM l),
k AS (SELECT * FROM n WHERE g > 0 QUALIFY t <= max(CASE WHEN hot THEN t END) OVER (PARTITION BY entity, g)),
f0 AS (SELECT entity, cut, min(t) - 5000 AS start_t, max(t) + 5500 AS end_t, max_by(t, (score, -t)) AS peak_t, max(score) AS max_score, avg(score) AS mean_score, count(*) AS points FROM k GROUP BY entity, cut, g),
f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY max_score DESC, entity, start_t) <= 5),
top AS (SELECT * FROM f ORDER BY max_score DESC, entity, start_t LIMIT 16), r1 AS (SELECT * FROM f ANTI JOIN top USING (entity, start_t)),
edge AS (SELECT * FROM r1 ORDER BY abs(max_score - (SELECT quantile_cont(cut, 0.5) FROM f)), entity, start_t LIMIT 16), r2 AS (SELECT * FROM r1 ANTI JOIN edge USING (entity, start_t)),
div AS (SELECT * FROM r2 ORDER BY row_number() OVER (PARTITION BY entity ORDER BY max_score DESC, start_t), max_score DESC, entity, start_t LIMIT 8),
ctl AS (SELECT entity, NULL::DOUBLE AS cut, t - 5000 AS start_t, t + 5500 AS end_t, t AS peak_t, score AS max_score, score AS mean_score, 1 AS points FROM p ORDER BY md5('20260819:' || entity || ':' || t), entity, t LIMIT 12),
u AS (SELECT *, 'active_top' AS selection_strategy, 'active' AS sampling_source FROM top UNION ALL SELECT *, 'active_boundary', 'active' FROM edge UNION ALL SELECT *, 'active_diverse', 'active' FROM div UNION ALL SELECT *, 'random_control', 'random' FROM ctl)
SELECT entity, start_t, end_t, peak_t, round(max_score, 9) AS max_score, round(mean_score, 9) AS mean_score, points, selection_strategy, sampling_source, (end_t - start_t) / 1000.0 AS duration_s FROM u""")
def review_queue(spark, sf):
    p = points(spark, sf).select("entity", F.col("entity").alias("cow"), "t", "score")
    q = mining.review_queue(p, ["entity"], "cow", "t", "score", 40, 5 / 48, quantile=0.9, gap=12 * HOUR)
    return q.select("entity", "start_t", "end_t", "peak_t", F.round("max_score", 9).alias("max_score"), F.round("mean_score", 9).alias("mean_score"), "points", "selection_strategy", "sampling_source", "duration_s")


@query("union_missing_columns", "SELECT o_orderkey AS id, o_totalprice AS value, NULL AS name FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def union_missing_columns(spark, sf):
    """Concatenation of tables with differing columns."""
    a = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return a.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), allowMissingColumns=True)


@query("set_operations", "(SELECT DISTINCT o_custkey AS k, 'both' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) UNION ALL (SELECT DISTINCT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def set_operations(spark, sf):
    """INTERSECT and EXCEPT of key sets."""
    o = table(spark, sf, "orders")
    keys = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    both = keys("F").intersect(keys("P")).withColumn("kind", F.lit("both"))
    return both.union(table(spark, sf, "customer").select("c_custkey").subtract(o.select("o_custkey")).withColumn("kind", F.lit("none")))
