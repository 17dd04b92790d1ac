"""Mixing sources to target weights by Pareto order sampling.

Each document first gets the whole copies that its expected number of copies makes certain. The rest of a source's
target is a fixed-size unequal-probability sample: documents are ranked by random odds over inclusion odds, and the
ranking is cut where its words come nearest to what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, text_of

#: Ranks are counted in this many bins per source; only the bin that holds the cut is ever sorted.
BINS, COARSE = 65_536, 256
SEED = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(key: Column, tie: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only, without a key on ``tie``: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("null:"), tie.cast("string")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, target. Targets fill by weight up to ``most`` times the source's size.

    With the sources sorted by cap over weight, the capped ones are a prefix; the water level is that of the first
    source that stays below its cap. One row per source, so the windows are over a short table.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    earlier, later = all_rows.rowsBetween(Window.unboundedPreceding, -1), all_rows.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("place", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    total = F.sum("source_size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    capped = F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    s = s.withColumn("level", (F.lit(share) * total - F.lit(most) * capped) / F.sum("weight").over(later))
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio")))
    level = level.over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("level", level).select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    quality: Column | None = None, seed: int = SEED, carry: bool = False,
) -> DataFrame:
    """One row per input row: key, size (words), source_size, target, copies, taken = size * copies.

    ``weights`` go to the sources in code-point order, null last, and repeat. ``quality`` makes the inclusion
    unequal within a source: the expected copies of a document are the source's rate times its quality over the
    source's mean, at most ``most``. Null text has size 0 and is never sampled. Rows without a key draw by their
    text; rows that repeat a key draw the same number and are ranked by size, then text; equal rows are interchangeable. Equal inputs give equal results on any
    number of partitions. An empty table gives an empty result; extra columns are ignored.
    """
    t = text_of(df, text)
    cols = [df[key].alias("id"), df[source].cast("string").alias("source"), word_count(t).alias("size"), F.xxhash64(t).alias("tie"), F.coalesce(quality if quality is not None else F.lit(1.0), F.lit(0.0)).alias("q")]
    narrow = cut(df.select(*cols), "mix-sizes")  # the one pass over the texts that the plan of the mix needs
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("q")).alias("sum_q"))
    goals = source_targets(sums.select("source", "source_size"), weights, share, most)
    rate = F.when(F.col("sum_q") > 0, F.col("target") / F.col("sum_q")).otherwise(0.0).alias("rate")
    goals = cut(sums.select(F.col("source").alias("s"), "sum_q").join(goals, F.col("s").eqNullSafe(F.col("source"))).select("s", "source_size", "target", rate), "mix-goals")

    def ranked(rows: DataFrame) -> DataFrame:
        """With whole copies (sure), inclusion odds, rank and the rank's bin; rank is null for what is never sampled."""
        expect = F.least(F.col("rate") * F.col("q"), F.lit(most))
        rows = rows.join(small(goals), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        rows = rows.withColumn("sure", F.floor(expect).cast("long")).withColumn("p", expect - F.floor(expect))
        u = uniform(F.col("id"), F.col("tie"), seed)
        odds = (u / (1 - u)) / F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("p") / (1 - F.col("p")))
        return rows.withColumn("rank", odds).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))

    by_source = Window.partitionBy("source")
    rows = ranked(narrow)
    # the cut is narrowed digit by digit: COARSE bins, then the COARSE fine bins of one, so that no source sums up many
    so_far = lambda c: F.sum("words").over(by_source.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    bins = rows.withColumn("coarse", F.floor(F.col("bin") / COARSE)).groupBy("source", "coarse").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("sure")).alias("certain"), F.max("target").alias("goal"))
    bins = bins.withColumn("need", F.max("goal").over(by_source) - F.sum("certain").over(by_source)).filter("coarse IS NOT NULL")
    bins = bins.withColumn("upto", so_far("coarse"))
    at = bins.filter(F.col("upto") > F.col("need")).groupBy(F.col("source").alias("s")).agg(F.min("coarse").alias("cut_coarse"), F.min_by("need", "coarse").alias("need"), F.min_by(F.col("upto") - F.col("words"), "coarse").alias("base"))
    at = cut(at, "mix-coarse")
    fine = rows.join(small(at), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("bin") / COARSE) == F.col("cut_coarse")))
    fine = fine.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("need").alias("need"), F.max("base").alias("base")).withColumn("upto", F.col("base") + so_far("bin"))
    at = fine.filter(F.col("upto") > F.col("need")).groupBy("source").agg(F.min("bin").alias("cut_bin"), F.min_by("need", "bin").alias("need"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"))
    at = cut(at.withColumnRenamed("source", "s"), "mix-bins")
    place = F.struct("rank", "id", "size", "tie")
    near = rows.join(small(at), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin")))
    near = near.withColumn("here", F.sum("size").over(by_source.orderBy("rank", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    last = near.filter(F.col("before") + F.col("here") - F.col("size") / 2 <= F.col("need")).groupBy(F.col("source").alias("s2")).agg(F.max(place).alias("last"))
    at = cut(at.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "cut_bin", "last"), "mix-cuts")

    if carry:
        rows = ranked(df.select(*cols, F.struct(*[df[c] for c in df.columns]).alias("row")))
    rows = rows.join(small(at), F.col("source").eqNullSafe(F.col("s")), "left")
    inside = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    out = rows.withColumn("copies", F.col("sure") + F.when(F.col("bin").isNotNull() & inside, 1).otherwise(0))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if carry else []))


def mixture(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's rows, each as often as it was taken; same columns."""
    rows = mix(df, carry=True, **options).filter("copies > 0")
    return rows.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
