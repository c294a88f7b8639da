"""Density clusters, cells of overlapping territories, final models, and tile counts over a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from voltweave.operators import density, learn, shapes
from voltweave.streaming import tiles


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side)]]


def test_cells_tell_who_covers_what():
    got = {k: shapes.area(v) for k, v in shapes.cells({"A": [square(0.0, 0.0, 4.0)], "B": [square(2.0, 2.0, 4.0)]}).items()}
    assert got == {("A",): pytest.approx(12), ("A", "B"): pytest.approx(4), ("B",): pytest.approx(12)}


def test_density_clusters_become_polygons(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(cx, 20), rng.gauss(cy, 20), 0.9, "solar" if i % 3 else "industrial") for i, (cx, cy) in enumerate([(0, 0)] * 30 + [(5000, 0)] * 25)] + [(99, 2500.0, 2500.0, 0.8, "solar")]
    points = spark.createDataFrame(rows, "id long, x double, y double, score double, cls string")
    named = density.density_clusters(points, 3, 5, "eom", 500.0).cache()
    assert named.where("id = 99").first()["cluster"] is None
    assert named.where("x < 1000 and cluster is not null").select("cluster").distinct().join(named.where("x > 4000").select("cluster"), "cluster").count() == 0
    rows = density.cluster_polygons(named, "score", "cls", ["solar", "industrial"]).collect()
    assert rows and all(r["dominant_class"] == "solar" and r["mean_score"] == 0.9 and r["hull_m2"] > 0 for r in rows)


def test_spread_nodes_stay_apart(spark):
    probes = spark.createDataFrame([(1, 7, 0.0, 0.0), (2, 7, 200.0, 0.0)], "id long, owner long, x double, y double")
    nodes = spark.createDataFrame([(1, 1.0, 0.0), (2, 10.0, 0.0), (3, 190.0, 0.0), (4, 205.0, 0.0)], "id long, x double, y double")
    got = [(r["node"], r["place"]) for r in density.spread_nodes(probes, nodes, 3, 50.0, 3).orderBy("place").collect()]
    assert got == [(1, 0), (3, 1)]


def test_trees_score_and_join(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 > 12).cast("int").alias("y"))
    folds = learn.stratified_folds(rows, "y", "id", 2)
    make = lambda trees=3: learn.boosted_trees(trees, 3, 0.3, 1.0, 1.0, 1)
    oof = learn.out_of_fold(folds, ["a"], "y", "fold", "id", make)
    assert oof.count() == 400 and learn.roc_auc(oof, "y_proba", "y_true").first()["auc"] == 1.0
    model = learn.final_model(rows, ["a"], "y", [2, 4], make)
    scored = learn.score_all(model, rows.select("id", "a"), ["a"], "id")
    assert learn.with_geometry(scored, rows.select("id"), "id").count() == 400
    assert learn.importances(model, ["a"])[0][0] == "a"


def test_stream_counts_equal_the_batch(spark, tmp_path):
    points = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 30).cast("timestamp").alias("ts"), (F.col("id") * 37 % 2000).cast("double").alias("x"), (F.col("id") * 53 % 2000).cast("double").alias("y"))
    points.write.parquet(str(tmp_path / "in"))
    stream = tiles.tile_windows(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), 500.0, "10 minutes", "5 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tile_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("tile_counts")) == key(tiles.tile_windows(points, 500.0, "10 minutes", "5 minutes"))
