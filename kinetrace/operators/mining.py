"""Review-queue mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .intervals import peaks
from .splits import shuffled


def capped(df: DataFrame, by: list[str], score: str, limit: Column, tie: list[str]) -> DataFrame:
    """The best ``limit`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def daily_cap(rate: Column, multiplier: float = 2.0) -> Column:
    return F.greatest(F.lit(1), F.bround(rate * 24 * multiplier).cast("int"))


def diverse(df: DataFrame, cow: str, score: str, count: int, tie: list[str]) -> DataFrame:
    """Spread over animals, then by score: everyone's best first, then everyone's second, and so on."""
    rounds = df.withColumn("_round", F.row_number().over(Window.partitionBy(cow).orderBy(F.col(score).desc(), *tie)))
    return rounds.orderBy("_round", F.col(score).desc(), *tie).limit(count).drop("_round")


def session_cut(points: DataFrame, by: list[str], score: str, quantile: float = 0.995, least: int = 3) -> DataFrame:
    """Linear quantile of scores per session; shorter sessions are left out."""
    return points.groupBy(*by).agg(F.percentile(score, F.lit(quantile)).alias("cut"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")


def review_queue(
    points: DataFrame, session: list[str], cow: str, time: str, score: str, budget: int = 40, rate: float | None = None, random_share: float = 0.3, top_share: float = 0.4, boundary_share: float = 0.4,
    quantile: float = 0.995, gap: int = 5000, step: int = 500, pad: int = 5000, seed: int = 20260819,
) -> DataFrame:
    """Exploitation, uncertainty and diversity picks plus a random control.

    Stages exclude each other by anti join on the candidate's session and start. Ties go to session, then start.
    """
    if random_share < 0.1:
        raise ValueError("a random control below 0.1 leaves precision and recall without an unbiased estimate")
    usable = points.filter(F.col(score).isNotNull() & ~F.isnan(score))
    cuts = session_cut(usable, session, score, quantile)
    hot = usable.join(F.broadcast(cuts), session) if cuts.count() <= 100_000 else usable.join(cuts, session)
    found = peaks(hot, [*session, cow, "cut"], time, score, F.col(score) >= F.col("cut"), gap, step, pad)
    tie = [*session, "start_t"]
    if rate is not None:
        found = capped(found, [cow, *session], "max_score", daily_cap(F.lit(rate)), tie)
    found = written(found, "review-candidates")  # five stages read it
    n_top, n_edge = round(budget * top_share), round(budget * boundary_share)
    n_diverse, n_random = max(0, budget - n_top - n_edge), round(budget * random_share)
    top = found.orderBy(F.col("max_score").desc(), *tie).limit(n_top)
    rest = found.join(top.select(*tie), tie, "left_anti")
    middle = found.agg(F.percentile("cut", F.lit(0.5)).alias("middle"))
    edge = rest.join(F.broadcast(middle), F.lit(True)).orderBy(F.abs(F.col("max_score") - F.col("middle")), *tie).limit(n_edge).drop("middle")
    rest = rest.join(edge.select(*tie), tie, "left_anti")
    spread = diverse(rest, cow, "max_score", n_diverse, tie)
    named = lambda d, s: d.withColumn("selection_strategy", F.lit(s)).withColumn("sampling_source", F.lit("active"))
    picked = usable.orderBy(shuffled(F.concat_ws(":", *session, time), seed), *session, time).limit(n_random)
    control = picked.select(*session, cow, F.lit(None).cast("double").alias("cut"), (F.col(time) - pad).alias("start_t"), (F.col(time) + step + pad).alias("end_t"), F.col(time).alias("peak_t"), F.col(score).alias("max_score"), F.col(score).alias("mean_score"), F.lit(1).cast("long").alias("points"), F.lit("random_control").alias("selection_strategy"), F.lit("random").alias("sampling_source"))
    queue = named(top, "active_top").unionByName(named(edge, "active_boundary")).unionByName(named(spread, "active_diverse")).unionByName(control, allowMissingColumns=True)
    return queue.withColumn("duration_s", (F.col("end_t") - F.col("start_t")) / 1000.0)


def numbered(queue: DataFrame, order: list[str]) -> DataFrame:
    """CND-00001 ids and the empty review columns of the sink (S16, T13). The queue is a budget's worth of rows."""
    d = queue.withColumn("candidate_id", F.format_string("CND-%05d", F.row_number().over(Window.orderBy(*order))))
    return d.withColumns({c: F.lit("") for c in ("review_decision", "reviewer", "reviewed_at", "notes")})
