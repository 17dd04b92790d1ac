"""Interval labels onto points: states, events, review masks, tail policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENTS, STATES, truthy
from .intervals import points_in


def label_points(points: DataFrame, annotations: DataFrame, by: list[str], time: str, width: int, states: tuple[str, ...] = STATES, events: tuple[str, ...] = EVENTS, strict: bool = True) -> DataFrame:
    """points (by, time) with body_target (-1 unlabelled) and event_CODE 0/1; ``annotations`` has code, start_t, end_t.

    Two different states on one point raise, or with ``strict=False`` set ``state_conflict`` so that one session
    cannot stop the others (Q8). Codes outside both vocabularies are read and ignored (P23).
    """
    known = annotations.filter(F.col("code").isin(*states, *events))
    hit = points_in(points.select(*by, time), known, by, time, "start_t", "end_t", width)
    body = F.coalesce(*[F.when(F.col("code") == s, F.lit(i)) for i, s in enumerate(states)])
    wide = hit.groupBy(*by, time).agg(F.min(body).alias("_lo"), F.max(body).alias("_hi"), *[F.max((F.col("code") == e).cast("int")).alias(f"event_{e}") for e in events])
    conflict = F.col("_lo") != F.col("_hi")
    out = points.join(wide, [*by, time], "left")
    if strict:
        out = out.withColumn("_lo", F.when(conflict, F.raise_error(F.lit("two states on one point")).cast("int")).otherwise(F.col("_lo")))
    else:
        out = out.withColumn("state_conflict", F.coalesce(conflict, F.lit(False)))
    return out.withColumns({"body_target": F.coalesce("_lo", F.lit(-1)), **{f"event_{e}": F.coalesce(f"event_{e}", F.lit(0)) for e in events}}).drop("_lo", "_hi")


def review_masks(points: DataFrame, coverage: DataFrame, by: list[str], time: str, width: int, events: tuple[str, ...] = EVENTS) -> DataFrame:
    """mask_CODE 0/1 where a reviewed interval of the code, ALL or * holds the point."""
    every = F.upper(F.trim("event_code")).isin("ALL", "*")
    rows = coverage.filter(truthy(F.col("exhaustive_reviewed"))).withColumn("event_code", F.explode(F.when(every, F.array(*map(F.lit, events))).otherwise(F.array("event_code"))))
    hit = points_in(points.select(*by, time), rows, by, time, "start_t", "end_t", width)
    wide = hit.groupBy(*by, time).agg(*[F.max((F.col("event_code") == e).cast("int")).alias(f"mask_{e}") for e in events])
    return points.join(wide, [*by, time], "left").withColumns({f"mask_{e}": F.coalesce(f"mask_{e}", F.lit(0)) for e in events})


def proxy_masks(df: DataFrame, events: tuple[str, ...] = EVENTS) -> DataFrame:
    """Without any coverage a point is supervised where its state is known (P25); a positive always is."""
    return df.withColumns({f"mask_{e}": F.greatest((F.col("body_target") >= 0).cast("int"), F.col(f"event_{e}")) for e in events})


def positives_supervised(df: DataFrame, events: tuple[str, ...] = EVENTS) -> DataFrame:
    return df.withColumns({f"mask_{e}": F.greatest(f"mask_{e}", f"event_{e}") for e in events})


def tail_policy(event: Column, mask: Column, excretion: Column, policy: str) -> tuple[Column, Column]:
    """Tail raised during excretion (P24): derive it as positive, exclude it from supervision, or leave it (legacy)."""
    inside = excretion > 0
    if policy == "derive":
        return F.greatest(event, inside.cast("int")), F.greatest(mask, inside.cast("int"))
    if policy == "exclude":
        return F.when(inside & (event == 0), 0).otherwise(event), F.when(inside & (event == 0), 0).otherwise(mask)
    if policy == "legacy":
        return event, mask
    raise ValueError(f"unknown policy {policy}")


def supervised(df: DataFrame, events: tuple[str, ...] = EVENTS) -> DataFrame:
    """Rows with a state, an event or a mask."""
    return df.filter((F.col("body_target") >= 0) | (F.greatest(*[F.col(f"{k}_{e}") for e in events for k in ("event", "mask")]) > 0))
