"""Global row numbers, running totals and exact quantiles, all without a single-task window.

Rows are range-partitioned by the order, handled in each partition, and shifted by the partitions before it; one row of
totals per partition comes to the driver.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.session import materialise


def _ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    return materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def _shift(totals: dict[int, float]) -> Column:
    """What the partitions before a row's own add up to."""
    parts = sorted(totals)
    before = accumulate([0, *(totals[p] for p in parts[:-1])])
    return F.element_at(F.create_map(*[F.lit(x) for p, b in zip(parts, before, strict=True) for x in (p, b)]), F.col("_part"))


def dense_rank_global(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's 0-based position in the order given, as a long.

    Rows that tie are numbered in an arbitrary order, so make the order total.
    """
    ranged = _ranged(df, order, "rank")
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(name, (number + _shift(counts)).cast("long")).drop("_part")


def rank_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds the row's 0-based position among the rows of its group, as a long; a group may hold any share of the rows."""
    ranked = materialise(dense_rank_global(df, [F.col(group), *order], name), "rank-within")
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")


def running_totals(df: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Adds for each {column: name} the column's sum up to and including the row, in a total order."""
    ranged = _ranged(df, order, "totals")
    rows = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    if not rows:
        return df.withColumns({name: F.col(c) for c, name in columns.items()})
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumns({name: F.sum(c).over(w) + _shift({r["_part"]: r[c] or 0 for r in rows}) for c, name in columns.items()}).drop("_part")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles, interpolated linearly, of several numeric columns; nulls don't count, columns without a value are left out.

    Equal values are counted first. The values in order are ranged over partitions, and only those at the positions asked
    for come to the driver: two for each column and share.
    """
    if not columns or not shares:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "value").where("value is not null")
    ranged = _ranged(long.groupBy("name", "value").agg(F.count("*").alias("n")), [F.col("name"), F.col("value")], "quantiles")
    totals: dict[str, dict[int, int]] = {}
    for r in ranged.groupBy("name", "_part").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["name"], {})[r["_part"]] = r["n"]
    if not totals:
        return {}
    asked = {c: [p * (sum(t.values()) - 1) for p in shares] for c, t in totals.items()}
    before, wanted = F.lit(0), F.array().cast("array<long>")
    for c, t in totals.items():
        of = F.col("name") == c
        before = F.when(of, _shift(t)).otherwise(before)
        wanted = F.when(of, F.array(*[F.lit(x).cast("long") for x in sorted({f(a) for a in asked[c] for f in (math.floor, math.ceil)})])).otherwise(wanted)
    last = F.sum("n").over(Window.partitionBy("name", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + before
    placed = ranged.select("name", "value", "n", last.alias("last"), wanted.alias("wanted"))
    hit = placed.withColumn("at", F.explode(F.filter("wanted", lambda x: (x < F.col("last")) & (x >= F.col("last") - F.col("n")))))
    value = {(r["name"], r["at"]): r["value"] for r in hit.select("name", "at", "value").collect()}
    out = {}
    for c, places in asked.items():
        out[c] = []
        for a in places:
            low, high = value[c, math.floor(a)], value[c, math.ceil(a)]
            out[c].append(low if low == high else (math.ceil(a) - a) * low + (a - math.floor(a)) * high)
    return {c: out[c] for c in columns if c in out}
