"""Density clusters of scored points as polygons with their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.functions.geometry import POINT
from voltweave.operators import clustering, shapes
from voltweave.operators import spatial_join as sj
from voltweave.operators.components import connected_components


def density_clusters(points: DataFrame, min_size: int, min_samples: int, method: str, reach: float) -> DataFrame:
    """points (id, x, y, ...) with cluster: the least id of the density cluster, null for noise.

    Points farther apart than reach never share a cluster, so each group chained within reach is clustered by itself, in one
    task: choose reach by the density of what is scored, as groups must fit there.
    """
    named = points.join(connected_components(clustering.near_pairs(points, reach)), F.col("id") == F.col("node"), "left")
    named = named.select("id", "x", "y", F.coalesce("component", "id").alias("component"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        labels = shapes.hdbscan(pdf[["x", "y"]].to_numpy(float), min_size, min_samples, method)
        if not (labels >= 0).any() and len(pdf) >= min_size and pdf[["x", "y"]].nunique().max() >= 1:
            labels = np.zeros(len(pdf), int) if method == "eom" else labels  # the group itself is one cluster, apart from others
        first = pdf["id"].groupby(labels).min()
        return pd.DataFrame({"id": pdf["id"], "cluster": [int(first[x]) if x >= 0 else None for x in labels]}).astype({"cluster": "Int64"})

    labels = named.groupBy("component").applyInPandas(run, "id long, cluster long")
    return points.join(labels, "id", "left")


def cluster_polygons(points: DataFrame, score: str, cls: str, classes: list[str], ratio: float = 0.25) -> DataFrame:
    """cluster, dominant_class, point_count, mean_score to three places, n_<class>, hull: one row per density cluster."""
    counts = [F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in classes]
    own = points.where("cluster is not null")
    stats = own.groupBy("cluster").agg(F.mode(cls, True).alias("dominant_class"), F.count("*").alias("point_count"), F.round(F.avg(score), 3).alias("mean_score"), *counts)

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = shapes.concave_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)), ratio)
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in ring]], "hull_m2": [shapes.ring_area(ring) if len(ring) > 2 else 0.0]})

    hulls = own.select("cluster", "x", "y").groupBy("cluster").applyInPandas(hull, f"cluster long, hull array<{POINT}>, hull_m2 double")
    return stats.join(hulls, "cluster")


def spread_nodes(probes: DataFrame, nodes: DataFrame, k: int, apart: float, most: int) -> DataFrame:
    """owner, node, place: for each owner up to `most` nodes near its probes, at least `apart` from one another.

    The k nearest nodes of every probe are candidates, in the order of the probes; taking them is greedy, so one owner's few
    candidates go through an Arrow function. probes: id, owner, x, y.
    """
    near = sj.k_nearest(sj.boxed_points(probes.select("id", "x", "y")), sj.boxed_points(nodes), k=k, cell=500.0)
    found = near.join(probes.select(F.col("id").alias("l_id"), "owner"), "l_id").join(nodes.select(F.col("id").alias("r_id"), "x", "y"), "r_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for r in pdf.sort_values(["l_id", "rank"]).itertuples():
            if len(out) < most and all(n != r.r_id and np.hypot(r.x - x, r.y - y) >= apart for _, n, x, y in out):
                out.append((r.owner, r.r_id, r.x, r.y))
        return pd.DataFrame([(o, n, i) for i, (o, n, _, _) in enumerate(out)], columns=["owner", "node", "place"])

    return found.select("owner", "l_id", "rank", "r_id", "x", "y").groupBy("owner").applyInPandas(run, "owner long, node long, place int")
