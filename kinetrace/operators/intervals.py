"""Event intervals: hysteresis, assembly, merging, snapping, overlap, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import small, written
from .timeline import over


def hysteresis(df: DataFrame, by: list[str], order: list[str], score: str, high: float, low: float) -> DataFrame:
    """Rows of runs of score >= low that reach high somewhere (W07). Runs are of adjacent rows; put a segment in ``by`` to stop them at gaps."""
    if low > high:
        raise ValueError("low exceeds high")
    w = over(by, order)
    rows = df.withColumn("_n", F.row_number().over(w)).filter(F.col(score) >= low)
    rows = rows.withColumn("_run", F.col("_n") - F.row_number().over(w))
    return rows.withColumn("_top", F.max(score).over(Window.partitionBy(*by, "_run"))).filter(F.col("_top") >= high).drop("_n", "_run", "_top")


def assemble(df: DataFrame, by: list[str], time: str, gap: int, step: int) -> DataFrame:
    """Intervals [start_t, end_t) of the given points: a gap beyond the limit splits, the last point lasts a step."""
    w = over(by, [time])
    rows = df.withColumn("_g", F.sum(F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_g").agg(F.min(time).alias("start_t"), (F.max(time) + step).alias("end_t")).drop("_g")


def merge_and_drop(intervals: DataFrame, by: list[str], merge_gap: Column, least: Column, start: str = "start_t", end: str = "end_t") -> DataFrame:
    """Join intervals at most the merge gap apart, then drop those shorter than the least length."""
    w = over(by, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_least", least).withColumn("_new", F.when(F.col(start) - reach > merge_gap, 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.max("_least").alias("_least"))
    return out.filter(F.col(end) - F.col(start) >= F.col("_least")).drop("_g", "_least")


#: Levels of blocks: 2 ** 40 leaves are 34 years of milliseconds at a leaf of one.
LEVELS = 40


def _halved(n: Column, level: Column) -> Column:
    """floor(n / 2 ** level), below zero too."""
    return F.call_function("shiftright", n, level)


def cover(df: DataFrame, start: Column, end: Column, leaf: int) -> DataFrame:
    """One row per dyadic block (``_level``, ``_block``) of the leaves that [start, end) touches: at most two a level.

    The blocks are disjoint, so a point lies in one of them at most. An interval of n leaves has at most 2 * log2(n) + 2
    blocks; one that is empty touches the leaf of its start.
    """
    lo = F.floor(start / leaf).cast("long")
    stop = F.floor(F.greatest(end - 1, start) / leaf).cast("long") + 1
    up = lambda level: -_halved(-F.col("_first_leaf"), level)  # noqa: E731  ceiling
    down = lambda level: _halved(F.col("_stop_leaf"), level)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1

    def blocks(level: Column) -> Column:
        a, b = up(level), down(level)
        first, last = F.when((a < b) & odd(a), a), F.when((a < b) & odd(b), b - 1)
        return F.transform(F.array_distinct(F.array_compact(F.array(first, last))), lambda n: F.struct(level.alias("_level"), n.alias("_block")))

    tall = F.least(F.ceil(F.log2(F.col("_stop_leaf") - F.col("_first_leaf"))) + 1, F.lit(LEVELS)).cast("int")
    rows = df.withColumn("_first_leaf", lo).withColumn("_stop_leaf", stop)
    rows = rows.withColumn("_dyadic", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), tall), blocks))))
    return rows.select(*df.columns, "_dyadic._level", "_dyadic._block")


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, width: int) -> DataFrame:
    """Inner join of points with half-open intervals that hold them.

    Points and the dyadic blocks of intervals meet on equal keys, level by level; a point asks only the levels that some
    interval uses. ``width`` is the leaf: intervals of about its length take one or two rows. Each pair comes once.
    """
    covered = cover(intervals, F.col(start), F.col(end), width)
    used = covered.agg(F.collect_set("_level").alias("_used"))  # one row of at most LEVELS + 1 numbers
    leaf = F.floor(F.col(time) / width).cast("long")
    asked = points.join(F.broadcast(used), F.lit(True)).withColumn("_level", F.explode("_used"))
    asked = asked.withColumn("_block", _halved(leaf, F.col("_level"))).drop("_used")
    return asked.join(covered, [*by, "_level", "_block"]).filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_block")


def overlap_pairs(a: DataFrame, b: DataFrame, by: list[str], width: int, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of the same group that overlap (half-open), each once.

    Of two that overlap, one starts inside the other: starts of ``b`` are points in ``a``, and starts of ``a`` that come
    later are points in ``b``.
    """
    (s1, e1), (s2, e2) = a_range, b_range
    both = (F.col(s1) < F.col(e2)) & (F.col(e1) > F.col(s2))
    inner = points_in(b, a, by, s2, s1, e1, width).filter(both)
    outer = points_in(a, b, by, s1, s2, e2, width).filter(both & (F.col(s1) > F.col(s2)))
    return inner.unionByName(outer)


def with_overlap_flag(a: DataFrame, b: DataFrame, by: list[str], key: list[str], width: int, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """``a`` with ``overlapped``: whether any interval of ``b`` in its group overlaps it (J08, semi and anti join in one)."""
    hit = overlap_pairs(a.select(*by, *key, *a_range), b.select(*by, *b_range), by, width, a_range, b_range).select(*by, *key).distinct().withColumn("overlapped", F.lit(True))
    return a.join(hit, [*by, *key], "left").withColumn("overlapped", F.coalesce("overlapped", F.lit(False)))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the span of both, whose length counts as one at least."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0)) / F.greatest(F.greatest(e1, e2) - F.least(s1, s2), F.lit(1))


#: Candidate pairs of one group up to which one task folds them.
FOLDED = 1_000_000


def best_pairs(pairs: DataFrame, by: list[str], ranks: list[str]) -> DataFrame:
    """Pairs (by, t, p) that are the first choice of both their sides: any greedy order takes them."""
    first = F.min(F.struct(*ranks, "t", "p")).alias("_best")
    sides = [pairs.groupBy(*by, side).agg(first).select(*by, "_best.t", "_best.p") for side in "tp"]
    return sides[0].join(sides[1], [*by, "t", "p"])


def greedy(pairs: DataFrame, by: list[str], rank: list[Column], truth: str, pred: str, folded: int = FOLDED) -> DataFrame:
    """One-to-one matching in ascending rank: a row (by, t, p) per match.

    A group of at most ``folded`` pairs is folded: its pairs stream in order through their partition and only the numbers
    already matched are held. Larger groups go by rounds over all tasks: pairs that are best for both sides are matched,
    and the other pairs of what they hold are dropped, which is what the fold would do. Once a group is small enough, or
    a round drops under a tenth of the pairs (long chains, each pair waiting for the one before), the fold ends it.
    Pairs with a null side or group match nothing.
    """
    ranks = [f"_r{i}" for i in range(len(rank))]
    rows = pairs.select(*by, *[c.alias(r) for c, r in zip(rank, ranks, strict=True)], F.col(truth).cast("long").alias("t"), F.col(pred).cast("long").alias("p"))
    rows = written(rows.filter(F.col("t").isNotNull() & F.col("p").isNotNull()).dropna(subset=by), "pairs")
    matched = []
    while True:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        hot = sizes.filter(F.col("_size") > folded).select(*by)
        before = sizes.filter(F.col("_size") > folded).agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        if not before:
            break
        large, rest = rows.join(small(hot), by, "left_semi"), rows.join(small(hot), by, "left_anti")
        taken = written(best_pairs(large, by, ranks), "matched")
        left = large.join(taken.select(*by, "t"), [*by, "t"], "left_anti").join(taken.select(*by, "p"), [*by, "p"], "left_anti")
        left = written(left.select(rows.columns), "pairs")
        matched.append(taken)
        rows = left.unionByName(rest)
        if left.count() > 0.9 * before:
            break

    def fold(frames):
        now, truths, preds = None, set(), set()
        for pdf in frames:
            keys, taken = zip(*(pdf[c] for c in by), strict=True), []
            for i, (key, t, p) in enumerate(zip(keys, pdf["t"].tolist(), pdf["p"].tolist(), strict=True)):
                if key != now:
                    now, truths, preds = key, set(), set()
                if t not in truths and p not in preds:
                    truths.add(t)
                    preds.add(p)
                    taken.append(i)
            yield pdf.iloc[taken]

    order = rows.repartition(*by).sortWithinPartitions(*by, *ranks, "t", "p").select(*by, "t", "p")
    out = order.mapInPandas(fold, order.schema)
    for taken in matched:
        out = out.unionByName(taken)
    return out


def listed(matched: DataFrame, by: list[str]) -> DataFrame:
    """Matches as array ``matches`` of (t, p) per group: for groups that fit a row."""
    return matched.groupBy(*by).agg(F.collect_list(F.struct("t", "p")).alias("matches"))


def tolerance_matches(truth: DataFrame, pred: DataFrame, by: list[str], tolerance: int, width: int) -> DataFrame:
    """Greedy by overlap of the widened truth, then truth and prediction numbers, all descending.

    ``truth`` has (by, ti, ts, te), ``pred`` (by, pi, ps, pe). A row (by, t, p) per match.
    """
    wide = truth.withColumn("_s", F.col("ts") - tolerance).withColumn("_e", F.col("te") + tolerance)
    pairs = overlap_pairs(wide, pred, by, width, ("_s", "_e"), ("ps", "pe"))
    overlap = F.least(F.col("_e"), F.col("pe")) - F.greatest(F.col("_s"), F.col("ps"))
    return greedy(pairs, by, [-overlap, -F.col("ti"), -F.col("pi")], "ti", "pi")


def iou_matches(truth: DataFrame, pred: DataFrame, by: list[str], least: float, width: int) -> DataFrame:
    """Greedy by IoU descending, then truth and prediction numbers ascending (J10). A row (by, t, p) per match."""
    pairs = overlap_pairs(truth, pred, by, width, ("ts", "te"), ("ps", "pe")).withColumn("iou", iou(F.col("ts"), F.col("te"), F.col("ps"), F.col("pe")))
    return greedy(pairs.filter(F.col("iou") >= least), by, [-F.col("iou"), F.col("ti"), F.col("pi")], "ti", "pi")


def match_with_tolerance(truth: DataFrame, pred: DataFrame, by: list[str], tolerance: int, width: int) -> DataFrame:
    return listed(tolerance_matches(truth, pred, by, tolerance, width), by)


def match_by_iou(truth: DataFrame, pred: DataFrame, by: list[str], least: float, width: int) -> DataFrame:
    return listed(iou_matches(truth, pred, by, least, width), by)


def snap(intervals: DataFrame, points: DataFrame, by: list[str], key: list[str], time: str, score: str, reach: int, least_score: float, least_length: int, width: int) -> DataFrame:
    """Move each end to the highest boundary score within reach (first on ties); undo if the result is too short."""

    def best(edge: str, name: str) -> DataFrame:
        near = intervals.select(*by, *key, F.col(edge).alias("_at"), (F.col(edge) - reach).alias("_lo"), (F.col(edge) + reach + 1).alias("_hi"))
        hit = points_in(points.filter(F.col(score) >= least_score).select(*by, F.col(time).alias("_t"), F.col(score).alias("_v")), near, by, "_t", "_lo", "_hi", width)
        return hit.groupBy(*by, *key).agg(F.max_by("_t", F.struct("_v", -F.col("_t"))).alias(name))

    rows = intervals.join(best("start_t", "_s"), [*by, *key], "left").join(best("end_t", "_e"), [*by, *key], "left")
    rows = rows.withColumn("_s", F.coalesce("_s", "start_t")).withColumn("_e", F.coalesce("_e", "end_t"))
    fits = F.col("_e") - F.col("_s") >= least_length
    return rows.withColumn("start_t", F.when(fits, F.col("_s")).otherwise(F.col("start_t"))).withColumn("end_t", F.when(fits, F.col("_e")).otherwise(F.col("end_t"))).drop("_s", "_e")


def interval_scores(intervals: DataFrame, points: DataFrame, by: list[str], key: list[str], time: str, score: str, width: int) -> DataFrame:
    """``max_prob`` of the points in each interval, rounded to 4 digits half to even, 0 if there are none."""
    best = points_in(points.select(*by, time, score), intervals.select(*dict.fromkeys([*by, *key, "start_t", "end_t"])), by, time, "start_t", "end_t", width).groupBy(*by, *key).agg(F.max(score).alias("max_prob"))
    return intervals.join(best, [*by, *key], "left").withColumn("max_prob", F.coalesce(F.bround("max_prob", 4), F.lit(0.0)))


def peaks(points: DataFrame, by: list[str], time: str, score: str, cut: Column, gap: int, step: int, pad: int) -> DataFrame:
    """Islands of points at or over the cut, and over all points between their ends: peak time, max, mean, count."""
    w = over(by, [time])
    rows = points.withColumn("_hot", cut)
    last = F.last(F.when(F.col("_hot"), F.col(time)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_hot") & (last.isNull() | (F.col(time) - last > gap)), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_g > 0")
    rows = rows.withColumn("_stop", F.max(F.when(F.col("_hot"), F.col(time))).over(Window.partitionBy(*by, "_g"))).filter(F.col(time) <= F.col("_stop"))
    return rows.groupBy(*by, "_g").agg(
        (F.min(time) - pad).alias("start_t"), (F.max(time) + step + pad).alias("end_t"), F.max_by(time, F.struct(F.col(score), -F.col(time))).alias("peak_t"),
        F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("points"),
    ).drop("_g")


def assemble_events(points: DataFrame, by: list[str], time: str, score: str, high: float, low: float | None, gap: int, step: int, merge_gap: Column, least: Column, boundary: DataFrame | None = None, reach: int = 3000, boundary_cut: float = 0.5, width: int = 60_000) -> DataFrame:
    """Scores to intervals: hysteresis, islands, optional snapping, merge and drop."""
    raw = assemble(hysteresis(points, by, [time], score, high, high * 0.6 if low is None else low), by, time, gap, step)
    if boundary is not None:
        raw = raw.withColumn("_i", F.row_number().over(over(by, ["start_t"])))
        raw = snap(raw, boundary, by, ["_i"], time, "boundary", reach, boundary_cut, step, width).drop("_i")
    return merge_and_drop(raw, by, merge_gap, least)


def owning_segment(points: DataFrame, segments: DataFrame, by: list[str], time: str, start: str, end: str, width: int, strict: bool = True) -> DataFrame:
    """Points with the segment that holds them (J05). A point outside every segment raises, or with ``strict=False`` is left out."""
    if not strict:
        return points_in(points, segments, by, time, start, end, width)
    marked = points_in(points.select(*by, time).distinct(), segments, by, time, start, end, width)
    inside = F.when(F.col(start).isNull(), F.raise_error(F.lit("a point lies outside every segment")).cast("long")).otherwise(F.col(start))
    return points.join(marked, [*by, time], "left").withColumn(start, inside)
