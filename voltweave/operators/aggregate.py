"""Aggregates of the feature families: weighted means, size statistics, modes and entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value times weight over the weight of rows that have a value; null without any."""
    have = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(have, F.lit(0.0))


def size_stats(pairs: DataFrame, key: str, size: str) -> DataFrame:
    """n, med, std (0 for one row) and total of a column per key."""
    return pairs.groupBy(key).agg(
        F.count("*").alias("n"), F.median(size).alias("med"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std"), F.sum(size).alias("total")
    )


def entropy_of_counts(n: str) -> Column:
    """Shannon entropy, in bits to four places, of values that occur n times each."""
    total = F.sum(n)
    # -sum(p log p) with p = n / total equals log(total) - sum(n log n) / total
    return F.abs(F.round(F.log2(total.cast("double")) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total, 4))


def mode_of_counts(value: str, n: str) -> Column:
    """The value of the largest n, the smallest of tied ones."""
    return F.min(F.struct((-F.col(n)).alias("k"), F.col(value).alias("v")))["v"]


def mode_and_entropy(rows: DataFrame, key: str, value: str, name: str = "mode") -> DataFrame:
    """Most common value per key, the smallest of tied ones, and the Shannon entropy in bits to four places."""
    per = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(mode_of_counts(value, "n").alias(name), entropy_of_counts("n").alias("entropy"))


def interpolated(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear from (x0, y0) to (x1, y1), constant beyond."""
    return F.lit(y0) + F.lit(y1 - y0) * (F.least(F.greatest(x, F.lit(x0)), F.lit(x1)) - F.lit(x0)) / F.lit(float(x1 - x0))


def point_class(infrastructure: Column, substation: Column, solar: Column) -> Column:
    """The class of a point by ordered rules; absent counts and nulls don't match."""
    return (
        F.when(F.coalesce(infrastructure, F.lit(0)) >= 1, "industrial").when(F.coalesce(substation, F.lit(False)), "substation").when(F.coalesce(solar, F.lit(False)), "solar").otherwise("residential")
    )


def sorted_list(column: str, distinct: bool = False) -> Column:
    """The group's values in order, joined by a comma and a blank."""
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return F.array_join(F.array_sort(values), ", ")
