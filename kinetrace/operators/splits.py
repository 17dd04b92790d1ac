"""Group-disjoint folds, holdouts and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .prefix import running


def shuffled(key: Column, seed: int) -> Column:
    """A permutation key from an MD5 digest: the same order in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def grouped_folds(groups: DataFrame, cow: str, folds: int = 5, validation: float = 0.2, seed: int = 20260819) -> DataFrame:
    """fold, cow, role: shuffled cows in blocks of near-equal size (the first take one more); validation is the first
    sorted cows of the rest (T10). One row per fold and cow; cows are numbered by ranges of either order, over all tasks.
    """
    cows = groups.select(cow).distinct().withColumn("_one", F.lit(1))
    c = running(cows, [], [shuffled(F.col(cow), seed), F.col(cow)], {"i": "_one"}, {"n": "_one"})[0].withColumn("i", F.col("i") - 1)
    k = F.least(F.greatest(F.lit(folds), F.lit(2)), F.col("n"))
    more, size = F.col("n") % k, F.floor(F.col("n") / k)
    big = more * (size + 1)
    block = F.when(F.col("i") < big, F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - big) / size))
    c = c.withColumn("block", block + 1).withColumn("k", k)
    every = written(c.select(cow, "_one", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k").cast("long"))).alias("fold")), "fold-blocks")
    rest, _ = running(every.filter("fold <> block"), ["fold"], [F.col(cow)], {"place": "_one"}, {"left": "_one"})
    role = F.when(F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("left") * validation)), "validation").otherwise("train")
    test = every.filter("fold = block").select("fold", cow, F.lit("test").alias("role"))
    return rest.select("fold", cow, role.alias("role")).union(test)


def protocol(folds: int, cows: int) -> str:
    return "grouped_kfold" if folds < cows else "strict_loco"


def holdout(groups: DataFrame, cow: str, share: float = 0.2, seed: int = 20260819) -> DataFrame:
    """Cows held out: the first of a shuffle, one at least, never all."""
    c = groups.select(cow).distinct()
    n = c.count()
    return c.orderBy(shuffled(F.col(cow), seed), cow).limit(max(1, min(n - 1, round(n * share))))


def leaks(assigned: DataFrame, fold: str, unit: str, role: str) -> DataFrame:
    """Units with more than one role in a fold."""
    return assigned.groupBy(fold, unit).agg(F.countDistinct(role).alias("roles")).filter("roles > 1")


def fold_rows(rows: DataFrame, folds: DataFrame, fold: int, role: str, cow: str) -> DataFrame:
    """Rows of the animals that have a role in a fold (J17); no such animal raises."""
    own = folds.filter((F.col("fold") == fold) & (F.col("role") == role)).select(cow)
    if own.isEmpty():
        raise ValueError(f"fold {fold} has no {role} animals")
    return rows.join(own, cow, "left_semi")


def fold_sessions(folds: DataFrame, sessions: DataFrame, cow: str, session: str) -> DataFrame:
    """Per fold and role the sorted set of its animals' sessions."""
    return folds.join(sessions.select(cow, session).distinct(), cow).groupBy("fold", "role").agg(F.array_sort(F.collect_set(session)).alias("sessions"))


def onto_rows(rows: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions back on the rows that they were made for (J16). Rows without one keep nulls; one key predicted twice raises."""
    once = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in predictions.columns if c not in keys])
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a row was predicted twice")).cast("long")).otherwise(F.col("_n")))
    return rows.join(once.filter(F.col("_n") == 1).drop("_n"), keys, "left")
