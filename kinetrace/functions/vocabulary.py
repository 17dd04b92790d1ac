"""Fixed vocabularies of the behaviour domain and lookups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, in their frozen order.
STATES = ("STANDING", "LYING", "WALKING", "FEEDING")
EVENTS = ("STANDING_UP", "LYING_DOWN", "URINATION", "DEFECATION", "TAIL_RAISED", "MOUNTING", "MOUNTED_BY")
DEPRECATED = ("TAIL_WAGGING",)
RATE_PER_HOUR = {"URINATION": 1.5, "DEFECATION": 2.5, "STANDING_UP": 4.0, "LYING_DOWN": 4.0, "TAIL_RAISED": 12.0, "MOUNTING": 8.0, "MOUNTED_BY": 8.0, "TAIL_WAGGING": 60.0}
MERGE_GAP_MS = {"STANDING_UP": 2000, "LYING_DOWN": 2000, "MOUNTING": 2000, "MOUNTED_BY": 2000, "URINATION": 5000, "DEFECATION": 4000, "TAIL_RAISED": 3000, "TAIL_WAGGING": 1500}
MIN_LENGTH_MS = {"STANDING_UP": 1000, "LYING_DOWN": 1000, "MOUNTING": 1000, "MOUNTED_BY": 1000, "URINATION": 4000, "DEFECATION": 3000, "TAIL_RAISED": 2000, "TAIL_WAGGING": 1000}
LEAST_EVENTS, LEAST_ANIMALS = 10, 3
RING_POSITIONS = ("root", "mid", "tip", "unknown")
NAMES = {
    "STANDING": ("standing", "站立"), "LYING": ("lying", "躺卧"), "WALKING": ("walking", "行走"), "FEEDING": ("feeding", "采食"), "STANDING_UP": ("standing up", "起立"), "LYING_DOWN": ("lying down", "卧下"), "URINATION": ("urination", "排尿"),
    "DEFECATION": ("defecation", "排便"), "TAIL_RAISED": ("tail raised", "抬尾"), "MOUNTING": ("mounting", "爬跨"), "MOUNTED_BY": ("mounted by another", "被爬跨"), "TAIL_WAGGING": ("tail wagging", "甩尾"),
}
STEP_MS, SAMPLE_MS, RATE_HZ = 500, 20, 50


def events_table(spark: SparkSession) -> DataFrame:
    """code, place, trained, rate_per_hour, merge_gap_ms, min_length_ms of every readable event."""
    rows = [(c, i, c in EVENTS, RATE_PER_HOUR[c], MERGE_GAP_MS[c], MIN_LENGTH_MS[c]) for i, c in enumerate((*EVENTS, *DEPRECATED))]
    return spark.createDataFrame(rows, "code string, place int, trained boolean, rate_per_hour double, merge_gap_ms long, min_length_ms long")


def names_table(spark: SparkSession) -> DataFrame:
    """code, name_en, name_zh of every state and event: a lookup to broadcast."""
    return spark.createDataFrame([(c, *n) for c, n in NAMES.items()], "code string, name_en string, name_zh string")


def posture(body: Column) -> Column:
    """Body class to posture: lying is 1, the other states 0, unlabelled -1."""
    return F.when(body < 0, F.lit(-1)).when(body == 1, F.lit(1)).otherwise(F.lit(0))


def walking(body: Column) -> Column:
    """Body class to walking: 1, 0, or -1 unlabelled."""
    return F.when(body < 0, F.lit(-1)).otherwise((body == 2).cast("int"))


def ring_position(text: Column) -> Column:
    """Normalised mounting position, else unknown."""
    low = F.lower(F.trim(text))
    return F.coalesce(F.when(low.isin(*RING_POSITIONS), low), F.lit("unknown"))


def truthy(text: Column) -> Column:
    """Review flag text (P10)."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def finite_or_zero(x: Column) -> Column:
    """Null, NaN and infinities become zero."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def resolved_threshold(override: Column, bundled: Column, default: float = 0.5) -> Column:
    """Explicit override in (0, 1), else the model's own, else the default."""
    inside = override.isNull() | ((override > 0) & (override < 1))
    return F.coalesce(F.when(inside, override).otherwise(F.raise_error(F.lit("threshold must lie in (0, 1)")).cast("double")), bundled, F.lit(default))


def session_key(device: Column, session: Column) -> Column:
    """device|session."""
    return F.concat_ws("|", device, session)


def cache_key(path: Column) -> Column:
    """Readable, collision-safe key of a path."""
    return F.concat_ws("_", F.btrim(F.regexp_replace(path, "[^0-9A-Za-z]+", "_"), F.lit("_")), F.substring(F.sha2(path.cast("binary"), 256), 1, 10))
