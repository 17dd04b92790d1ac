"""Day layer: indicators per animal and day, individual baselines, deviations, alerts (A09 - A13, section 2.9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import with_rising_edges


@dataclass(frozen=True)
class DayLimits:
    window: str = "after"
    least_days: int = 2
    skip_days: int = 1
    robust: bool = True
    alert: float = 2.5
    top_share: float = 0.05
    fired: float = 0.5
    least_windows: int = 3
    relative_floor: float = 0.10
    absolute_floor: float = 0.05
    clip: float = 10.0


def indicators(df: DataFrame, by: list[str], time: str, lying: Column | None, walking: Column | None, events: dict[str, Column], step_seconds: float = 0.5) -> DataFrame:
    """One row per animal and day; a missing state counts as never, a missing event as none."""
    rows = df.withColumn("_l", F.coalesce(lying, F.lit(False)) if lying is not None else F.lit(False)).withColumn("_w", F.coalesce(walking, F.lit(False)) if walking is not None else F.lit(False))
    rows = with_rising_edges(rows, by, [time], F.col("_l"))
    hours = step_seconds / 3600.0
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"), (F.count(F.lit(1)) * hours).alias("observed_hours"), (F.count_if("_l") * hours).alias("lying_hours"), (F.count_if("_w") * hours).alias("walking_hours"), (F.count_if(~F.col("_l")) * hours).alias("upright_hours"),
        F.sum("bout_start").alias("lying_bouts"), F.sum("changed").alias("posture_transitions"), *[F.sum(c.cast("double")).alias(f"{k}_count") for k, c in events.items()],
    )
    return out.withColumn("activity_index", F.col("walking_hours") * 2.0 + F.col("posture_transitions") * 0.05)


def baseline(df: DataFrame, by: list[str], value: str, day: Column | None, event_day: Column | None, limits: DayLimits = DayLimits()) -> DataFrame:
    """centre, spread, days per animal from days clear of the event (A10); null under the least number of days.

    Two aggregations, the second over deviations from the first's median. Without an event day every day counts.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if event_day is not None:
        off = F.datediff(day, event_day)
        keep = F.abs(off) > limits.skip_days
        keep = keep & (off > 0) if limits.window == "after" else keep & (off < 0) if limits.window == "before" else keep
        rows = rows.filter(keep)
    rows = rows.select(*by, F.col(value).cast("double").alias("v"))
    if limits.robust:
        centre = rows.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("centre"), F.count("v").alias("days"))
        spread = rows.join(centre, by).groupBy(*by).agg((F.percentile(F.abs(F.col("v") - F.col("centre")), F.lit(0.5)) * 1.4826).alias("spread"))
        out = centre.join(spread, by)
    else:
        out = rows.groupBy(*by).agg(F.avg("v").alias("centre"), F.count("v").alias("days"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("spread"))
    floor = F.greatest(limits.relative_floor * F.abs("centre"), F.lit(limits.absolute_floor))
    enough = F.col("days") >= limits.least_days
    return out.select(*by, F.when(enough, F.col("centre")).alias("centre"), F.when(enough, F.greatest("spread", floor)).alias("spread"), "days")


def deviations(df: DataFrame, cow: str, day: str, directions: dict[str, float], event_day: Column | None = None, limits: DayLimits = DayLimits()) -> DataFrame:
    """z per indicator (clipped) and the direction-signed weighted mean ``estrus_score`` over those that exist."""
    long = df.select(cow, day, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("x"), F.lit(float(d)).alias("d")) for k, d in directions.items()])).alias("e")).select(cow, day, "e.k", "e.x", "e.d")
    base = baseline(long, [cow, "k"], "x", F.col(day), event_day, limits)
    z = long.join(base, [cow, "k"], "left").withColumn("z", F.greatest(F.least((F.col("x") - F.col("centre")) / F.col("spread"), F.lit(limits.clip)), F.lit(-limits.clip)))
    weight, known = F.abs("d"), F.col("z").isNotNull()
    return z.groupBy(cow, day).agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z_{k}") for k in directions], (F.sum(F.when(known, F.col("z") * F.col("d"))) / F.sum(F.when(known, weight))).alias("estrus_score"))


def alert(score: Column, limits: DayLimits = DayLimits()) -> Column:
    """Finite and at least the limit."""
    return F.coalesce((score >= limits.alert) & ~F.isnan(score), F.lit(False))


def window_scores(df: DataFrame, by: list[str], score: str, limits: DayLimits = DayLimits()) -> DataFrame:
    """top_k_mean, noisy_or, fired_windows, windows and the alert per day."""
    v = F.col(score)
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(limits.top_share)))).withColumn("_r", F.row_number().over(w.orderBy(v.desc())))
    clipped = F.least(F.greatest(v, F.lit(1e-9)), F.lit(1 - 1e-9))
    out = rows.groupBy(*by).agg(F.avg(F.when(F.col("_r") <= F.col("_k"), v)).alias("top_k_mean"), (1 - F.exp(F.sum(F.log1p(-clipped)))).alias("noisy_or"), F.count_if(v >= limits.fired).alias("fired_windows"), F.count(F.lit(1)).alias("windows"))
    return out.withColumn("alert", (F.col("fired_windows") >= limits.least_windows) & (F.col("top_k_mean") >= limits.fired))


def return_to_service(df: DataFrame, cow: str, day: Column, alarm: Column, bred: Column, cycle: int = 21, tolerance: int = 4) -> DataFrame:
    """Whether an alert came back about one cycle after insemination, and the verdict (J20, section 2.9)."""
    inside = F.abs(F.datediff(day, bred) - cycle) <= tolerance
    out = df.groupBy(cow).agg(F.count_if(inside).alias("days_observed"), F.coalesce(F.bool_or(F.when(inside, alarm)), F.lit(False)).alias("returned"))
    return out.withColumn("verdict", F.when(F.col("days_observed") == 0, "not_observed").when(F.col("returned"), "open_suspected").otherwise("pregnancy_suspected"))


def lead_hours(alarm_ms: Column, reference_ms: Column) -> Column:
    return (reference_ms - alarm_ms) / 3_600_000
