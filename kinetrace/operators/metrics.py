"""Frame, segment, deployment, per-animal and day-level metrics. Null means not evaluable, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import LEAST_ANIMALS, LEAST_EVENTS
from ..sources.scratch import written
from .prefix import join_groups, quantiles, running


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def confusion(df: DataFrame, actual: str, predicted: str, classes: int, by: list[str] = ()) -> DataFrame:
    """Counts on the full class grid; unlabelled rows (actual < 0) are left out."""
    spark = df.sparkSession
    seen = df.filter(F.col(actual) >= 0).groupBy(*by, F.col(actual).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    axis = spark.range(classes)
    grid = axis.select(F.col("id").alias("actual")).join(F.broadcast(axis.select(F.col("id").alias("predicted"))), F.lit(True))  # classes are few by contract
    if by:
        grid = df.select(*by).distinct().join(F.broadcast(grid), F.lit(True))
    return grid.join(seen, [*by, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_scores(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class of a confusion matrix; absent classes score zero."""
    pairs = matrix.select(*by, F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(1).alias("side")), F.struct(F.col("predicted").alias("class"), F.lit(2).alias("side")))).alias("k"), "actual", "predicted", "n")
    c, side = F.col("k.class"), F.col("k.side")
    s = pairs.groupBy(*by, c.alias("class")).agg(
        F.sum(F.when((side == 1) & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(side == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(side == 2, F.col("n")).otherwise(0)).alias("called"),
    )
    p, r = or_zero(ratio(F.col("tp"), F.col("called"))), or_zero(ratio(F.col("tp"), F.col("support")))
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", or_zero(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select(*by, "class", "precision", "recall", "f1", "support")


def multiclass(df: DataFrame, actual: str, predicted: str, classes: int, by: list[str] = ()) -> DataFrame:
    """evaluated, macro_f1 over all classes, mof (share right)."""
    m = confusion(df, actual, predicted, classes, by)
    right = m.groupBy(*by).agg(F.sum("n").alias("evaluated"), ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("mof"))
    macro = class_scores(m, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    return right.join(macro, list(by)) if by else right.join(F.broadcast(macro), F.lit(True))  # one row each


def curve(df: DataFrame, by: list[str], actual: str, score: str) -> tuple[DataFrame, bool]:
    """Per distinct score, descending: predicted so far, true so far, positives and rows in all (A17, A18); whether groups are few.

    Rows are grouped by score first, so that ties count once; running counts are those of ``prefix``, so a group of any
    number of distinct scores is spread over the tasks.
    """
    steps = df.groupBy(*by, score).agg(F.sum(F.col(actual).cast("long")).alias("pos"), F.count(F.lit(1)).alias("_n"))
    return running(steps, by, [F.col(score).desc()], {"tp": "pos", "called": "_n"}, {"positives": "pos", "rows": "_n"})


def average_precision(df: DataFrame, by: list[str], actual: str, score: str) -> DataFrame:
    """Sum of recall steps times precision, tied scores together; null unless both classes are there."""
    c, _ = curve(df, by, actual, score)
    both = (F.max("positives") > 0) & (F.max("positives") < F.max("rows"))
    return c.groupBy(*by).agg(F.when(both, F.sum(F.col("pos") / F.when(F.col("positives") > 0, F.col("positives")) * F.col("tp") / F.col("called"))).alias("average_precision"))


def choose_threshold(df: DataFrame, by: list[str], actual: str, score: str, beta: float = 1.0, most_positive: float | None = None) -> DataFrame:
    """Best F-beta over distinct scores, ties (1e-12) to the closest to one half, then the lowest; one class: 0.5.

    A bound on the share called positive that no score meets is dropped.
    """
    b2 = beta * beta
    c, few = curve(df, by, actual, score)
    c = c.filter((F.col("positives") > 0) & (F.col("positives") < F.col("rows")))
    p, r = F.col("tp") / F.col("called"), F.col("tp") / F.col("positives")
    c = c.withColumn("_f", F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0))
    within = F.col("called") / F.col("rows") <= (1.0 if most_positive is None else most_positive)
    tops = c.groupBy(*by).agg(F.max("_f").alias("_all"), F.max(F.when(within, F.col("_f"))).alias("_bounded"))
    tops = tops.select(*by, F.coalesce("_bounded", "_all").alias("best_f"), F.col("_bounded").isNotNull().alias("_bound"))
    c = join_groups(c.withColumn("_ok", within), tops, by, fits=few).filter((F.col("_ok") | ~F.col("_bound")) & (F.col("_f") >= F.col("best_f") - 1e-12))
    best = c.groupBy(*by).agg(F.min_by(score, F.struct(F.abs(F.col(score) - 0.5), score)).alias("threshold"), F.max("best_f").alias("best_f"))
    groups = df.select(*by).distinct()
    return groups.join(best, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def binary_points(df: DataFrame, by: list[str], actual: str, score: str, threshold: Column) -> DataFrame:
    """Masked frame metrics with their evidence scope (A16). Rows outside the mask are left out by the caller."""
    a, called = F.col(actual) == 1, F.col(score) >= threshold
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(a).alias("positive"), F.count_if(~a).alias("negative"), F.count_if(called).alias("predicted_positive"), F.count_if(called & ~a).alias("false_positive"), F.count_if(called & a).alias("_tp"))
    precision, recall = or_zero(ratio(F.col("_tp"), F.col("predicted_positive"))), or_zero(ratio(F.col("_tp"), F.col("positive")))
    both, some = (F.col("positive") > 0) & (F.col("negative") > 0), F.col("positive") > 0
    g = g.withColumn("scope", F.when(both, "positive_and_trusted_negative").when(some, "positive_only_recall").otherwise("trusted_negative_only"))
    g = g.withColumn("false_positive_rate", ratio(F.col("false_positive"), F.col("negative"))).withColumn("precision", F.when(both, precision)).withColumn("recall", F.when(some, recall))
    g = g.withColumn("f1", F.when(both, or_zero(ratio(2 * F.col("_tp"), F.col("predicted_positive") + F.col("positive"))))).drop("_tp")
    return g.join(average_precision(df, by, actual, score), by)


def evidence(events: Column, animals: Column) -> Column:
    """Whether figures of an event may be claimed at all."""
    return F.when((events >= LEAST_EVENTS) & (animals >= LEAST_ANIMALS), "evaluable").otherwise("not_evaluable")


def f1_of(tp: Column, truth: Column, pred: Column) -> Column:
    return or_zero(ratio(2 * tp, truth + pred))


def edit_score(df: DataFrame, a: str, b: str) -> Column:
    """100 * (1 - edit distance / longer length) of run strings; both empty is 100."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(a, b) / longest) * 100).otherwise(100.0)


def localisation(df: DataFrame, by: list[str], delta: Column) -> DataFrame:
    """Median and linear 90th percentile of absolute onset differences."""
    d = df.select(*by, F.abs(delta).alias("_d"))
    counts, spread = d.groupBy(*by).agg(F.count(F.lit(1)).alias("matched")), quantiles(d, by, F.col("_d"), {"median": 0.5, "p90": 0.9})
    return counts.join(spread, by, "left") if by else counts.join(F.broadcast(spread), F.lit(True))  # one row each


def plausibility(count: Column, hours: Column, bound: Column) -> Column:
    """Rate against its hourly ceiling: up to 1 plausible, up to 5 suspicious, beyond implausible."""
    times = count / hours / bound
    return F.when(bound.isNull() | (hours <= 0), "unknown").when(times <= 1, "plausible").when(times <= 5, "suspicious").otherwise("implausible")


def draw(seed: int, resample: Column, place: Column, n: Column) -> Column:
    """A number below n from an MD5 digest: the same in every engine and on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), place.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n)


#: Draws that one step of a resample makes at once, groups of a block, and groups whose blocks may be broadcast (8 bytes each at most).
DRAWS, BLOCK, MOST_GROUPS = 1 << 16, 1 << 12, 1 << 22


def picks(rows: DataFrame, resamples: DataFrame, n: int, seed: int, what: Column) -> DataFrame:
    """r, x: for each draw of each resample (column r), what the drawn one of ``rows`` has, whose ``i`` is 0 to n - 1.

    Draws are made in pieces over many tasks and look x up where they are made, in blocks of ``BLOCK`` rows each that are
    plain arrays. More groups than ``MOST_GROUPS`` meet their draws in a shuffle.
    """
    pieces = resamples.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(DRAWS)))).repartition(max(200, 8 * rows.sparkSession.sparkContext.defaultParallelism), "r", "_from")
    slots = pieces.select("r", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + DRAWS, F.lit(n)) - 1)).alias("j"))
    drawn = slots.select("r", draw(seed, F.col("r"), F.col("j"), F.lit(n)).alias("i"))
    own = rows.select("i", what.alias("x"))
    if n > MOST_GROUPS:
        return drawn.join(own.hint("shuffle_hash"), "i").select("r", "x")
    blocks = own.groupBy(F.floor(F.col("i") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("_x"))
    return drawn.join(F.broadcast(blocks), F.floor(F.col("i") / BLOCK) == F.col("_block")).select("r", F.get("_x", F.pmod("i", F.lit(BLOCK)).cast("int")).alias("x"))


def resampled_medians(rows: DataFrame, resamples: DataFrame, n: int, seed: int, reach: int) -> DataFrame:
    """r, m: the exact median of each resample; ``rows`` also have ``q``, their place by value.

    Draws up to ``reach`` places off the middle are counted one by one, those below and above only together. A resample whose
    middle lies outside, which its counts tell, is drawn again and counted in full. Values join the places found at the end.
    """
    low, high = (n - 1) // 2, n // 2
    place = F.when(F.col("q").between(low - reach, high + reach), F.col("q")).when(F.col("q") < low, -1).otherwise(n).cast("int")
    c = picks(rows, resamples, n, seed, place).groupBy("r", F.col("x").alias("q")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("r").orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("k") <= rank) & F.col("q").between(0, n - 1), F.col("q")))
    found = written(c.withColumn("upto", upto).groupBy("r").agg(at(low).alias("lo"), at(high).alias("hi")), "bootstrap-medians")
    missed = found.filter("lo IS NULL OR hi IS NULL").select("r")
    middle = found.filter("lo IS NOT NULL AND hi IS NOT NULL").select("r", F.explode(F.array("lo", "hi")).alias("q"))
    out = rows.select("q", "v").join(F.broadcast(middle), "q").groupBy("r").agg(F.avg("v").alias("m"))  # two rows a resample
    return out if missed.isEmpty() else out.unionByName(resampled_medians(rows, missed, n, seed, n))


def bootstrap(groups: DataFrame, value: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 20260819, statistic: str = "mean") -> DataFrame:
    """Interval of the mean or the median by resampling groups, one row each (``groups`` has one row per animal).

    Every resample draws as many groups as there are; one group gives no bounds. Groups are numbered by ranges of their
    order. Means are summed up as they are drawn, and of the draws for a median only those near the middle are kept apart
    (4 root n places to either side, eight deviations), so that what is shuffled grows with the root of the groups.
    """
    spark = groups.sparkSession
    rows = groups.filter(F.col(value).isNotNull()).select("entity", F.col(value).cast("double").alias("v"), F.lit(1).alias("_one"))
    place = lambda d, name, *order: running(d, [], list(order), {name: "_one"})[0].withColumn(name, F.col(name) - 1)
    rows = place(rows, "i", F.col("entity").asc_nulls_last())
    rows = written((place(rows, "q", F.col("v"), F.col("i")) if statistic == "median" else rows).drop("entity", "_one"), "bootstrap-groups")
    n = rows.count()
    point = {"mean": lambda: rows.agg(F.avg("v").alias("point")), "median": lambda: quantiles(rows, [], F.col("v"), {"point": 0.5})}[statistic]()
    if n < 2:
        return point.select("point", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(n).cast("long").alias("groups"))
    every = spark.range(resamples).withColumnRenamed("id", "r")
    means = picks(rows, every, n, seed, F.col("v")).groupBy("r").agg(F.avg("x").alias("m")) if statistic == "mean" else resampled_medians(rows, every, n, seed, int(4 * n**0.5) + 1)
    a = (1 - confidence) / 2
    out = means.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))
    return point.join(F.broadcast(out), F.lit(True)).withColumn("groups", F.lit(n).cast("long"))


def day_level(df: DataFrame, truth: Column, alarm: Column, lead: Column, cow: str) -> DataFrame:
    """Sensitivity, specificity, PPV, lead-time quartiles of true alarms, false alarms per animal and week."""
    rows = df.select(truth.alias("t"), alarm.alias("a"), lead.alias("l"), F.col(cow).alias("c"))
    leads = quantiles(rows, [], F.when(F.col("t") & F.col("a"), F.col("l")), {"lead_median": 0.5, "lead_q25": 0.25, "lead_q75": 0.75})
    s = rows.agg(
        F.count(F.lit(1)).alias("cow_days"), F.count_if(F.col("t") & F.col("a")).alias("tp"), F.count_if(~F.col("t") & F.col("a")).alias("fp"), F.count_if(F.col("t") & ~F.col("a")).alias("fn"), F.count_if(~F.col("t") & ~F.col("a")).alias("tn"),
    ).join(F.broadcast(leads), F.lit(True))
    weekly = rows.groupBy("c").agg((F.count_if(~F.col("t") & F.col("a")) / F.count(F.lit(1)) * 7.0).alias("w")).agg(F.avg("w").alias("false_alarms_per_cow_per_week"))
    s = s.withColumn("sensitivity", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("ppv", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return s.join(F.broadcast(weekly), F.lit(True))


def selection_score(posture: Column, walking: Column, events: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted mean of the available parts; null without any."""
    parts = list(zip(weights, (posture, walking, events), strict=True))
    total = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts[1:]), F.when(parts[0][1].isNotNull(), parts[0][0]).otherwise(0.0))
    return ratio(sum((w * F.coalesce(x, F.lit(0.0)) for w, x in parts[1:]), parts[0][0] * F.coalesce(parts[0][1], F.lit(0.0))), total)
