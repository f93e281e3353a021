"""Reports over runs and samples, as aggregations and joins that leave the strategy to the optimiser."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scoring import quality_class


def mean_scores(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean of both scores. A failed run is left out, an empty answer counts as 0."""
    value = lambda c: F.when(F.col("status") == "empty", 0.0).when(F.col("status") != "failed", F.col(c))
    return runs.groupBy(*keys).agg(F.avg(value("levenshtein")).alias("levenshtein"), F.avg(value("teds")).alias("teds"))


def mean_time(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg("processing_time").alias("time_seconds"))


def success_rate(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg((~F.col("success")).cast("double")).alias("error_rate"))


def shares(samples: DataFrame, *keys: str) -> DataFrame:
    """Number and share of the samples of each key; the groups, not the samples, meet in one window."""
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def exact_mean(value: Column) -> Column:
    """Mean of values as decimals, to 15 places: the same in any order of the rows, which a sum of doubles is not. Values
    that no such decimal holds (over 10^10, NaN, infinite) are summed as doubles."""
    d = value.try_cast("decimal(28, 18)")
    return F.when(F.count(d) == F.count(value), F.round(F.avg(d), 15).cast("double")).otherwise(F.avg(value))


def breakdown(runs: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Runs, share of successes and mean scores of every set of keys in one pass: of all subsets, or of those given.

    A key that a row sums over is null, and its bit in level is 1 (the last key has the lowest bit).
    """
    score = lambda c: exact_mean(F.when(F.col("status") == "empty", 0.0).when(F.col("status") != "failed", F.col(c).cast("double"))).alias(c)
    grouped = runs.cube(*keys) if sets is None else runs.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return grouped.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), score("levenshtein"), score("teds"))


def size_class(rows: Column, columns: Column) -> Column:
    return (
        F.when(columns == 1, "single column").when(columns > 10, "large").when(columns.between(3, 6) & rows.between(5, 15), "medium").when((rows < 5) & (columns <= 6), "small").otherwise("other")
    )


def prevalence(samples: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Share of the samples that have each feature; features overlap."""
    return samples.agg(*(F.avg(c.cast("int")).alias(n) for n, c in flags.items()))


def diagnosis(scored: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Number of samples in each of the four classes of the two scores, one row for each key."""
    names = ["good", "content without structure", "structure without content", "poor"]
    return scored.withColumn("class", quality_class(F.col("levenshtein"), F.col("teds"), threshold)).groupBy(key).pivot("class", names).count().na.fill(0)


def ranked(scores: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """scores in order of a column, with the rank. One row for each model meets in the window."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return scores.withColumn("rank", F.rank().over(Window.orderBy(order))).orderBy("rank")


def trade_off(scores: DataFrame, speed: DataFrame) -> DataFrame:
    """Scores beside times, with whether no other model is both better and faster (the models are compared by a running best)."""
    both = scores.join(speed, "name")
    faster = Window.orderBy("time_seconds", F.col("levenshtein").desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("levenshtein").over(faster)
    return both.withColumn("best_of_its_speed", best.isNull() | (F.col("levenshtein") > best))
