"""Queries over fold runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..drivers import folds
from ..functions.vocabulary import EVENTS
from ..models.boosting import POSTURE
from ..operators import metrics, splits
from ..operators.timeline import over
from ..sources.scratch import written
from ..sources.tables import POINTS, points
from .catalog import query
from .drivers import Ratio

#: Users as animals with a session each; user 0 to 9 have no known posture.
ROWS = f"""{POINTS}, n AS (SELECT entity AS cow, id, round(score, 3) AS score, row_number() OVER (PARTITION BY entity ORDER BY t, id) AS i, code FROM p),
d AS (SELECT cow, i, score, CASE WHEN cow < 10 THEN -1 WHEN score > 0.45 AND id % 3 > 0 THEN 1 WHEN code = 'click' THEN 2 ELSE 0 END AS body, (score > 0.6 AND id % 4 > 0)::INT AS y, (id % 7 > 0)::INT AS m FROM n),
w AS (SELECT DISTINCT cow FROM d), c AS (SELECT cow, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('20260819:' || cow), cow) - 1 AS i FROM w),
b AS (SELECT cow, i, n, CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // (n // 4) END + 1 AS block FROM c),
x AS (SELECT unnest(range(1, 5)) AS fold, cow, block FROM b),
r AS (SELECT fold, cow, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY cow) <= greatest(1, round_even(count(*) OVER (PARTITION BY fold) * 0.2, 0)) THEN 'validation' ELSE 'train' END AS role FROM x WHERE fold <> block
      UNION ALL SELECT fold, cow, 'test' FROM x WHERE fold = block),
vs AS (SELECT fold, score, sum(y) AS pos, count(*) AS n FROM d JOIN r USING (cow) WHERE role = 'validation' AND m = 1 GROUP BY ALL),
vk AS (SELECT fold, score, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY fold) AS positives FROM vs WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
vf AS (SELECT fold, score, 2 * (tp / called) * (tp / positives) / nullif(tp / called + tp / positives, 0) AS f FROM vk),
h AS (SELECT fold, min_by(score, (abs(score - 0.5), score)) AS threshold FROM (SELECT *, max(f) OVER (PARTITION BY fold) AS top FROM vf) WHERE f >= top - 1e-12 GROUP BY fold),
s AS (SELECT fold, d.*, threshold FROM d JOIN r USING (cow) JOIN h USING (fold) WHERE role = 'test')"""


def run(spark, sf):
    """Four folds over users. Each fold learns its threshold on its validation animals; scores are given, so SQL can follow."""
    d = points(spark, sf).withColumn("i", F.row_number().over(over(["entity"], ["t", "id"]))).withColumn("score", F.round("score", 3))
    body = F.when(F.col("entity") < 10, -1).when((F.col("score") > 0.45) & (F.col("id") % 3 > 0), 1).when(F.col("code") == "click", 2).otherwise(0)
    own = {"event_URINATION": ((F.col("score") > 0.6) & (F.col("id") % 4 > 0)).cast("int"), "mask_URINATION": (F.col("id") % 7 > 0).cast("int")}
    rows = d.select(F.concat(F.lit("k"), F.col("entity")).alias("cache_key"), F.col("entity").alias("cow_id"), F.lit("d").alias("device_mac"), F.col("entity").cast("string").alias("session_id"), F.col("i").cast("long").alias("center_index"), (F.col("i") * 500).cast("long").alias("center_time_ms"), "score", body.alias("body_target"), *[c.alias(k) for k, c in own.items()])
    rows = rows.withColumns({f"{p}_{e}": F.lit(0) for e in EVENTS for p in ("event", "mask") if f"{p}_{e}" not in own})

    rows = written(rows, "fold-rows")

    def fit(train, validation):
        own = validation.filter("mask_URINATION = 1")
        best = metrics.choose_threshold(own.withColumn("all", F.lit(1)), ["all"], "event_URINATION", "score").first()
        if best is None or best["best_f"] is None:  # one class: the SQL takes the lowest score, or without positives that closest to one half
            best = own.agg(F.coalesce(F.min(F.when(F.col("event_URINATION") == 1, F.col("score"))), F.min_by("score", F.struct(F.abs(F.col("score") - 0.5), "score"))).alias("threshold")).first()
        if best["threshold"] is None:
            raise folds.Unfit("no validation rows under the mask")
        best = best["threshold"]
        return [Ratio(POSTURE, F.col("score"), 0.5), Ratio("WALKING", 1 - F.col("score"), 0.5), Ratio("URINATION", F.col("score"), best)]

    return folds.run_folds(rows, splits.grouped_folds(rows, "cow_id", 4), fit)


@query("fold_runs", f"""
WITH {ROWS}, k AS (SELECT fold, (body = 1)::INT AS a, (score >= 0.5)::INT AS c, (body = 2)::INT AS w, 1 - score AS u FROM s WHERE body >= 0),
z AS (SELECT fold, v, coalesce(2.0 * count(*) FILTER (a = v AND c = v) / nullif(count(*) FILTER (a = v) + count(*) FILTER (c = v), 0), 0) AS f1 FROM k, (SELECT unnest([0, 1]) AS v) GROUP BY ALL),
ws AS (SELECT fold, u, sum(w) AS pos, count(*) AS n FROM k GROUP BY ALL), wk AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS called, sum(pos) OVER (PARTITION BY fold) AS positives FROM ws WINDOW o AS (PARTITION BY fold ORDER BY u DESC ROWS UNBOUNDED PRECEDING)),
wa AS (SELECT fold, sum(pos / positives * tp / called) AS ap FROM wk GROUP BY fold),
es AS (SELECT fold, score, sum(y) AS pos, count(*) AS n FROM s WHERE m = 1 GROUP BY ALL), ek AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS called, sum(pos) OVER (PARTITION BY fold) AS positives FROM es WINDOW o AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ea AS (SELECT fold, sum(pos / positives * tp / called) AS ap FROM ek GROUP BY fold), pf AS (SELECT fold, avg(f1) AS f1 FROM z GROUP BY fold), t AS (SELECT fold, count(DISTINCT cow) AS cows, count(*) AS points, any_value(threshold) AS threshold FROM s GROUP BY fold)
SELECT fold, 'complete' AS status, cows AS test_cows, points AS test_points, round(threshold, 9) AS threshold, round(pf.f1, 9) AS posture_macro_f1, round(wa.ap, 9) AS walking_ap, round(ea.ap, 9) AS event_ap, round(0.5 * pf.f1 + 0.3 * wa.ap + 0.2 * ea.ap, 9) AS selection_score
FROM t JOIN pf USING (fold) JOIN wa USING (fold) JOIN ea USING (fold)""")
def fold_runs(spark, sf):
    """Summary of every fold: thresholds of its own animals, metrics on its test animals."""
    done = run(spark, sf)
    n = lambda c: F.count_if(F.expr(c))
    held = done.scored.groupBy("fold").agg(F.round(F.max("threshold_URINATION"), 9).alias("threshold"), n("body_target >= 0").alias("known"), n("body_target = 2").alias("walks"), n("mask_URINATION = 1").alias("seen"), n("mask_URINATION = 1 AND event_URINATION = 1").alias("events"))
    d = done.summary.join(held.filter("known > 0 AND seen > 0"), "fold")  # the SQL leaves out folds with nothing to measure; the summary keeps them
    d = d.withColumn("walking_ap", F.when(F.col("walks") == F.col("known"), 1.0).otherwise(F.col("walking_ap"))).withColumn("event_ap", F.when(F.col("events") == F.col("seen"), 1.0).otherwise(F.col("event_ap")))
    score = F.when(F.col("walking_ap").isNotNull() & F.col("event_ap").isNotNull(), metrics.selection_score(F.col("posture_macro_f1"), F.col("walking_ap"), F.col("event_ap")))
    d = d.withColumn("selection_score", score)
    return d.select("fold", "status", "test_cows", "test_points", "threshold", *[F.round(c, 9).alias(c) for c in ("posture_macro_f1", "walking_ap", "event_ap", "selection_score")])


@query("fold_events", f"""
WITH {ROWS}, e AS (SELECT fold, cow, i * 500 AS t, y, (score >= threshold)::INT AS c FROM s WHERE m = 1),
a AS (SELECT fold, cow, t, 'truth' AS side FROM e WHERE y = 1 UNION ALL SELECT fold, cow, t, 'pred' FROM e WHERE c = 1),
g AS (SELECT *, sum(CASE WHEN gap > 750 THEN 1 ELSE 0 END) OVER (PARTITION BY fold, cow, side ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, t - lag(t) OVER (PARTITION BY fold, cow, side ORDER BY t) AS gap FROM a)),
v AS (SELECT fold, cow, side, min(t) AS s, max(t) + 500 AS e FROM g GROUP BY fold, cow, side, run),
q AS (SELECT *, sum(CASE WHEN s - reach > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY fold, cow ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(e) OVER (PARTITION BY fold, cow ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE side = 'pred')),
u AS (SELECT fold, count(*) AS pred FROM (SELECT fold, cow, k FROM q GROUP BY fold, cow, k HAVING max(e) - min(s) >= 4000) GROUP BY fold)
SELECT fold, (SELECT count(*) FROM e x WHERE x.fold = o.fold) AS points, (SELECT count(*) FROM v x WHERE x.fold = o.fold AND side = 'truth') AS truth, coalesce(pred, 0)::BIGINT AS pred FROM (SELECT DISTINCT fold FROM e) o LEFT JOIN u USING (fold)""")
def fold_events(spark, sf):
    """Test points, true and predicted intervals of every fold."""
    return run(spark, sf).events.filter("event_code = 'URINATION'").select("fold", "points", "truth", "pred")
