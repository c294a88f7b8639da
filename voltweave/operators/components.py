"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.session import materialise, release

#: Far more rounds than any graph needs: the depth halves with each.
MAX_ROUNDS = 60
#: Contracted edges up to which one task finishes the work; beyond it rounds of stars do, with the same result.
SMALL = 50_000
#: Nodes that a task holds at once; more than SMALL edges can have, so that the last task holds all of its.
HELD = 1_000_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: a star for each component of every HELD nodes met, so memory is bounded."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield _stars(parent, find)
            parent.clear()
    if parent:
        yield _stars(parent, find)


def _stars(parent: dict, find: Callable) -> pd.DataFrame:
    out = [(x, r) for x in parent if (r := find(x)) != x]
    return pd.DataFrame(out, columns=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row (node, component) per node with an edge to another; component is the least node of its component.

    With few edges left after the partitions' contraction, one task ends the work. Null ends, self-loops and repeated edges are ignored. Partitions are first contracted by union-find, then large-star and
    small-star operations alternate until every node points at its component's least node: O(log n) rounds, each cut by a
    table in the shared folder. Hubs are handled by partial aggregation and by joins that Spark can split.
    """
    kind = edges.schema[u].dataType.simpleString()
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    stars = f"u {kind}, v {kind}"
    state = materialise(edges.mapInPandas(_contract, stars), "components")
    if state.count() <= SMALL:
        state = materialise(state.coalesce(1).mapInPandas(_contract, stars), "components")
        return _named(state)
    mark = None
    for _ in range(MAX_ROUNDS):
        new = materialise(_small_star(_large_star(state)), "components")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(state)
        state = new
        if row == mark:
            return _named(state)
        mark = row
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
