"""Audit, balance, coverage, storage and verification reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import LEAST_ANIMALS, LEAST_EVENTS
from .prefix import join_groups, quantiles


def annotation_audit(df: DataFrame, code: str, cow: str, session: str, start: str, end: str, to_seconds: float) -> DataFrame:
    """Per code: annotations, animals, sessions, seconds (mean, exact median, max), minutes."""
    s = (F.col(end) - F.col(start)) * to_seconds
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct(cow).alias("animals"), F.countDistinct(session).alias("sessions"), F.avg(s).alias("mean_s"), F.max(s).alias("max_s"), (F.sum(s) / 60).alias("minutes"))
    return join_groups(counts, quantiles(df, [code], s, {"median_s": 0.5}), [code], "left")


def evaluability(vocabulary: DataFrame, audit: DataFrame, code: str) -> DataFrame:
    """Every code of the vocabulary with its counts and whether they suffice."""
    d = vocabulary.join(audit.select(code, "annotations", "animals"), code, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("annotations", "animals")})
    return d.withColumn("evaluable", (F.col("annotations") >= LEAST_EVENTS) & (F.col("animals") >= LEAST_ANIMALS))


def balance(df: DataFrame, cow: str) -> DataFrame:
    """animals, largest share, animals that hold 80 %, inverse Simpson number."""
    n = df.groupBy(cow).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), cow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = n.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("so_far", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole))
    return d.agg(F.count(F.lit(1)).alias("animals"), F.max("share").alias("largest_share"), (F.count_if(F.col("so_far") < 0.8) + 1).alias("animals_for_80"), (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_animals"))


def segments(bounds: DataFrame, seconds: Column) -> DataFrame:
    """Count, minimum, median, mean and maximum length of segments."""
    rows = bounds.select(seconds.alias("s"))
    counts = rows.agg(F.count(F.lit(1)).alias("segments"), F.min("s").alias("min_s"), F.avg("s").alias("mean_s"), F.max("s").alias("max_s"))
    return join_groups(counts, quantiles(rows, [], F.col("s"), {"median_s": 0.5}), [])


def segment_histogram(bounds: DataFrame, key: Column) -> DataFrame:
    """Sessions by number of segments."""
    return bounds.groupBy(key.alias("session")).agg(F.count(F.lit(1)).alias("segments")).groupBy("segments").agg(F.count(F.lit(1)).alias("sessions"))


def coverage(df: DataFrame, code: str, session: list[str], reviewed: Column, hours: Column) -> DataFrame:
    """Reviewed hours and sessions per code, with a verdict."""
    d = df.filter(reviewed).groupBy(code).agg(F.sum(hours).alias("reviewed_hours"), F.countDistinct(F.struct(*session)).alias("sessions"))
    return d.withColumn("verdict", F.when(F.col("reviewed_hours") > 0, "claimable").otherwise("not_claimable"))


def mask_hours(df: DataFrame, masks: dict[str, Column], step_seconds: float = 0.5) -> DataFrame:
    """Supervised hours per event mask, long form."""
    sums = df.agg(*[(F.count_if(m) * step_seconds / 3600).alias(k) for k, m in masks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("hours")) for k in masks])).alias("r")).select("r.code", "r.hours")


def fold_report(assigned: DataFrame, sizes: DataFrame, cow: str, least: int = 1000) -> DataFrame:
    """Per fold: animals by role, test samples, usable or not."""
    d = assigned.join(sizes, cow, "left")
    return d.groupBy("fold").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_cows") for r in ("train", "validation", "test")], F.coalesce(F.sum(F.when(F.col("role") == "test", F.col("n"))), F.lit(0)).alias("test_samples")).withColumn("usable", F.col("test_samples") >= least)


def diagnostics(annotations: DataFrame, vocabulary: DataFrame, segments_: DataFrame | None = None, reviews: DataFrame | None = None, folds: DataFrame | None = None, points: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of a data report by name, those whose tables are given.

    ``annotations`` has code, cow_id, session_id, t_start_rel_ms, t_end_rel_ms; ``segments_`` cache_key, start_index,
    stop_index (50 Hz); ``reviews`` session_id, event_code, exhaustive_reviewed, t_start_rel_ms, t_end_rel_ms; ``folds`` fold,
    cow_id, role; ``points`` cow_id, one row per supervised point.
    """
    audit = annotation_audit(annotations, "code", "cow_id", "session_id", "t_start_rel_ms", "t_end_rel_ms", 0.001)
    out = {"annotations": audit, "evaluability": evaluability(vocabulary, audit, "code").select("code", "annotations", "animals", "evaluable"), "balance": balance(annotations if points is None else points, "cow_id")}
    if segments_ is not None:
        out["segments"] = segments(segments_, (F.col("stop_index") - F.col("start_index")) / 50.0)
        out["segments per session"] = segment_histogram(segments_, F.col("cache_key"))
    if reviews is not None:
        out["coverage"] = coverage(reviews, "event_code", ["session_id"], F.col("exhaustive_reviewed").cast("boolean"), (F.col("t_end_rel_ms") - F.col("t_start_rel_ms")) / 3_600_000.0)
    if folds is not None:
        sizes = (annotations if points is None else points).groupBy("cow_id").agg(F.count(F.lit(1)).alias("n"))
        out["folds"] = fold_report(folds, sizes, "cow_id")
    return out


def channel_statistics(df: DataFrame, by: list[str], order: list[str], channels: list[str], first: int = 200_000) -> DataFrame:
    """Mean and deviation per channel over the first rows of each session; variance floored at 1e-8."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= first)
    return d.agg(*[F.avg(c).alias(f"{c}_mean") for c in channels], *[F.sqrt(F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(1e-8))).alias(f"{c}_std") for c in channels])


def normalised(x: Column, mean: Column, std: Column) -> Column:
    """z value with a floor under the deviation."""
    return (x - mean) / F.greatest(std, F.lit(1e-6))


def positive_weight(df: DataFrame, by: list[str], positive: Column, most: float = 20.0) -> DataFrame:
    """Negatives per positive in [1, most]; 1 without positives; the plain ratio beside it, null without positives."""
    d = df.groupBy(*by).agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))
    ratio = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    return d.withColumn("ratio", ratio).withColumn("weight", F.coalesce(F.least(F.greatest(ratio, F.lit(1.0)), F.lit(most)), F.lit(1.0)))


def storage(cows: Column, days: Column, rate: int = 50) -> list[Column]:
    """frames, and GiB at 52 and 18 bytes a frame."""
    frames = cows.cast("long") * days * 24 * 3600 * rate
    gib = lambda b: frames * b / (1024.0**3)
    return [frames.alias("frames"), gib(52).alias("gib_schema1"), gib(18).alias("gib_schema2"), (F.lit(52) / F.lit(18)).alias("ratio")]


def check(name: str, severity: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")


def verify(checks: list[DataFrame]) -> DataFrame:
    """Union of checks with the overall verdict on each row: any error row makes FAIL."""
    rows = reduce(DataFrame.union, checks)
    verdict = F.when(F.max(F.when((F.col("severity") == "error") & (F.col("n") > 0), 1).otherwise(0)).over(Window.partitionBy(F.lit(1))) == 1, "FAIL").otherwise("PASS")
    return rows.withColumn("verdict", verdict)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """U04 on a schema."""
    return sorted(set(needed) - set(df.columns))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).filter("_r = 1").drop("_r")


def unmatched(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side: sessions without a cache, caches without a session."""
    there = a.select(*key).distinct().withColumn("_a", F.lit(True)).join(b.select(*key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return there.filter("_a IS NULL OR _b IS NULL").select(*key, F.when(F.col("_a").isNull(), "right_only").otherwise("left_only").alias("side"))


def data_checks(annotations: DataFrame, codes: tuple[str, ...], sessions: DataFrame | None = None, caches: DataFrame | None = None, folds: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """The seven checks of a data set, as far as their tables are given (A35): duplicate ids, intervals without length,
    unknown codes, missing columns, sessions against caches, leaks between roles of a fold, values that are not finite.
    """
    needed = ("event_id", "code", "t_start_rel_ms", "t_end_rel_ms", "cow_id", "session_id")
    spark = annotations.sparkSession
    lost = missing_columns(annotations, list(needed))
    checks = [check("missing_columns", "error", spark.createDataFrame([(c,) for c in lost], "name string"))]
    has = lambda *c: not set(c) & set(lost)
    if has("event_id"):
        checks.append(check("duplicate_event_id", "error", duplicates(annotations, ["event_id"])))
    if has("t_start_rel_ms", "t_end_rel_ms"):
        checks.append(check("empty_interval", "error", annotations.filter("t_end_rel_ms <= t_start_rel_ms")))
    if has("code"):
        checks.append(check("unknown_code", "warning", annotations.filter(~F.col("code").isin(*codes))))
    if sessions is not None and caches is not None:
        checks.append(check("sessions_without_cache", "error", unmatched(sessions, caches, ["cache_key"])))
    if folds is not None:
        checks.append(check("leak_between_roles", "error", folds.groupBy("fold", "cow_id").agg(F.countDistinct("role").alias("roles")).filter("roles > 1")))
    if numbers is not None:
        columns = [c for c, kind in numbers.dtypes if kind in ("float", "double")]
        checks.append(check("not_finite", "error", numbers.filter(reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns], F.lit(False)))))
    return verify(checks)
