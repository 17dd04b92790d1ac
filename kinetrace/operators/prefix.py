"""Running totals and exact quantiles of groups of any size, without a window or a buffer per group.

Rows are dealt over tasks by ranges of their order, so that a group lies in as many tasks as its rows need. A task adds up
its own rows; what lies ahead of it is a sum over the short table of per-task totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import is_small, small, written


def join_groups(d: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", fits: bool | None = None) -> DataFrame:
    """Join on keys that may be null; ``other`` has each key once. ``fits``: whether it is known to be small, else it is counted."""
    renamed = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    if not keys:
        return d.join(F.broadcast(renamed), F.lit(True), how)  # one row
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    side = small(renamed) if fits is None else F.broadcast(renamed) if fits else renamed
    return d.join(side, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] = {}) -> tuple[DataFrame, bool]:
    """``df`` with running sums (name: column) along the order within ``by``, and the groups' totals (name: column); and
    whether tables of one row per group may be broadcast.

    ``by`` and ``order`` together name a row. The rows are written once, range by range, so that a repeated task sees the
    same ranges; the window runs within a group's rows of one range. Totals per range and group, at most one row per group
    and one more per range, are all that meets between ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "prefix-rows")
    columns = sorted({*sums.values(), *totals.values()})
    parts = written(dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns]), "prefix-ranges")
    fits = is_small(parts)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_a_{c}") for c in sorted(set(sums.values()))])
    out = join_groups(dealt, ahead, [*by, "_range"], fits=fits)
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({name: F.col(f"_a_{c}") + F.sum(c).over(within) for name, c in sums.items()})
    if totals:
        out = join_groups(out, parts.groupBy(*by).agg(*[F.sum(f"_s_{c}").alias(name) for name, c in totals.items()]), by, fits=fits)
    return out.drop("_range", *[f"_a_{c}" for c in columns]), fits


def quantiles(df: DataFrame, by: list[str], value: Column, at: dict[str, float]) -> DataFrame:
    """by and the linear quantiles (name: share) of the non-null values of each group; exact, ties counted once.

    A group's distinct values lie in many tasks; each quantile picks the two values whose ranks enclose it. Without
    ``by`` there is one row, of nulls if there are no values.
    """
    counts = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    r, _ = running(counts, by, [F.col("_v")], {"_upto": "_n"}, {"_all": "_n"})
    first = F.col("_upto") - F.col("_n")
    spot = lambda p: (F.col("_all") - 1) * F.lit(p)
    of_rank = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col("_v")))
    cols = []
    for i, p in enumerate(at.values()):
        cols += [of_rank(F.floor(spot(p))).alias(f"_lo{i}"), of_rank(F.ceil(spot(p))).alias(f"_hi{i}")]
    g = r.groupBy(*by).agg(F.max("_all").alias("_all"), *cols)

    def between(i: int, p: float) -> Column:
        h, lo, hi = spot(p), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(F.floor(h) == F.ceil(h), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    return g.select(*by, *[between(i, p).alias(name) for i, (name, p) in enumerate(at.items())])
