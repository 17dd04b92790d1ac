"""Exact duplicates by content sort.

Splitters sampled from the texts deal the normalised bytes over range partitions, an external sort places equal texts
side by side, and the window over equal neighbours compares whole texts. A splitter is as long as it takes to tell
two neighbours of the sample apart, so texts that share a long prefix are still split by what comes after it. No text
is reduced to a hash.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small, text_of

#: Sampled rows per partition.
SAMPLES = 20


def unchanged(text: Column) -> Column:
    return text


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two texts have in common at their start, by halving."""
    mid = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    step = lambda s, _: F.when(F.left(a, mid(s)) == F.left(b, mid(s)), state(mid(s), s["hi"])).otherwise(state(s["lo"], F.greatest(mid(s) - 1, s["lo"])))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(31)), state(F.lit(0), F.least(F.length(a), F.length(b))), step, lambda s: s["lo"]), F.lit(0))


def splitters(texts: DataFrame, n: int) -> list[tuple[str, int]]:
    """About n ascending (lower bound, pieces) of ranges of column ``t``: the quantiles of a sample of n * SAMPLES rows.

    A text that takes several quantiles is hot: its range gets as many pieces. The driver gets at most 2n bounds.
    """
    total = texts.count()
    s = texts.sample(min(1.0, n * SAMPLES / max(total, 1)), seed=5).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("t")  # over the sample only
    s = s.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("before", F.lag("t").over(order)).withColumn("after", F.lead("t").over(order))
    quantile = lambda at: F.least(F.floor(at * n / F.col("all")), F.lit(n - 1))
    s = s.withColumn("pieces", (quantile(F.col("upto")) - quantile(F.col("upto") - F.col("c"))).cast("int")).filter("pieces > 0")
    low = F.struct(F.left("t", shared_prefix(F.col("before"), F.col("t")) + 1).alias("low"), "pieces")
    end = F.struct(F.left("after", shared_prefix(F.col("t"), F.col("after")) + 1).alias("low"), F.lit(1).alias("pieces"))
    found = s.select(F.explode(F.when(F.col("pieces") > 1, F.array(low, end)).otherwise(F.array(low))).alias("b")).select("b.*")
    return [tuple(r) for r in found.filter("low IS NOT NULL").groupBy("low").agg(F.max("pieces")).sort("low").collect()]


def deal(text: Column, salt: Column, bounds: list[tuple[str, int]]) -> tuple[int, Column, Column]:
    """Number of partitions, the partition of a text by binary search of its range, and whether that range is hot."""
    pieces = [1, *(p for _, p in bounds)]
    first = list(accumulate(pieces, initial=0))
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")  # noqa: E731  (folded to a constant)
    lows = fixed([b for b, _ in bounds], "string")
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(lows, mid(s)) <= text, state(mid(s) + 1, s["hi"])).otherwise(state(s["lo"], mid(s)))
    place = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), state(F.lit(0), F.lit(len(bounds))), step, lambda s: s["lo"])
    dealt = F.get(F.transform(F.array(place), lambda i: F.struct((F.get(fixed(first, "int"), i) + F.pmod(salt, F.get(fixed(pieces, "int"), i)).cast("int")).alias("part"), (F.get(fixed(pieces, "int"), i) > 1).alias("hot"))), F.lit(0))
    return first[-1], dealt["part"], dealt["hot"]


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min", normalise=unchanged, carry: bool = False) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256 (and the input row as struct ``row`` on request).

    Equal texts form a group of which the row with the smallest (``keep='max'``: largest) key stays. Null text is
    the empty text. A null key never stays while its group has another key; repeated rows count one by one and
    exactly one of them stays. An empty table gives an empty result. Other columns are ignored, whatever their names.

    A text of more rows than a partition's share is sorted in pieces, dealt by key and task; each piece then gives one
    row, and the pieces of a text are compared in full again to find the survivor.
    """
    cols = [df[key].alias("id"), normalise(text_of(df, text)).alias("t")] + ([F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else [])
    rows = df.select(*cols)
    bounds = splitters(rows.select("t"), partitions(df.sparkSession))
    n, part, hot = deal(F.col("t"), F.xxhash64("id", F.spark_partition_id()), bounds)
    rows = rows.withColumn("part", part).withColumn("hot", hot)
    equal = Window.partitionBy("part", "t")
    first, best = (F.col("id").asc_nulls_last(), F.min) if keep == "min" else (F.col("id").desc_nulls_last(), F.max)

    def sort(r: DataFrame) -> DataFrame:
        r = r.repartitionById(n, F.col("part"))
        return r.withColumn("place", F.row_number().over(equal.orderBy(first))).withColumn("piece_id", best("id").over(equal)).withColumn("piece_n", F.count(F.lit(1)).over(equal))

    def shown(r: DataFrame, keep_id: str, size: str, home: Column) -> DataFrame:
        kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col(keep_id)) & home
        return r.select(F.col("id").alias(key), F.col(keep_id).alias("keep_id"), F.col(size).alias("group_size"), kept.alias("kept"), F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), *(["row"] if carry else []))

    if all(p == 1 for _, p in bounds):
        return shown(sort(rows.drop("hot")), "piece_id", "piece_n", F.lit(True))
    # rows of hot ranges are written with their piece, so that it stays; their texts are summed up before any shuffle
    few = cut(rows.filter("hot").drop("hot"), "exact-hot")
    none = (F.col("id").isNull() if keep == "min" else F.col("id").isNotNull()).alias("none")
    pick = best(F.struct(none, "id", "part")).alias("pick")  # the survivor is at home in one piece
    totals = few.groupBy("t").agg(pick, F.count(F.lit(1)).alias("all_n"))
    totals = cut(totals.select(F.col("t").alias("hot_t"), F.col("pick.id").alias("all_id"), "all_n", F.col("pick.part").alias("home")), "exact-totals")
    hot_rows = sort(few).join(small(totals), F.col("t") == F.col("hot_t"))
    return shown(sort(rows.filter("NOT hot").drop("hot")), "piece_id", "piece_n", F.lit(True)).unionByName(shown(hot_rows, "all_id", "all_n", F.col("home") == F.col("part")))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min", normalise=unchanged) -> DataFrame:
    """The input without the rows that lost to an equal text; same columns."""
    return exact_groups(df, key, text, keep, normalise, carry=True).filter("kept").select("row.*")
