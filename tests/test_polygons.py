"""Polygon operators over the geometry struct."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from voltweave.operators import polygons as po
from voltweave.sources import codecs


def square(x: float, y: float, side: float) -> str:
    return f"POLYGON (({x} {y}, {x + side} {y}, {x + side} {y + side}, {x} {y + side}, {x} {y}))"


@pytest.fixture(scope="module")
def zones(spark):
    rows = [(1, "a", square(0, 0, 4)), (2, "a", square(2, 2, 4)), (3, "b", square(100, 0, 10))]
    return codecs.geometry_column(spark.createDataFrame(rows, "id long, k string, geom string")).drop("geom").cache()


def test_dissolve(zones):
    got = {r["k"]: (r["n"], r["area"]) for r in po.dissolve(zones, "k").collect()}
    assert got == {"a": (2, pytest.approx(28)), "b": (1, pytest.approx(100))}
    assert sorted(r["area"] for r in po.dissolve(zones).collect()) == [pytest.approx(28), pytest.approx(100)]
    again = po.dissolve(zones, "k").select("k", po.area(F.col("geom_")).alias("a")).orderBy("k").collect()
    assert [r["a"] for r in again] == [pytest.approx(28), pytest.approx(100)]


def test_overlaps_and_repairs(zones, spark):
    pairs = po.overlap_pairs(zones, zones, 50.0).where("l_id < r_id").collect()
    assert [(r["l_id"], r["r_id"], r["area"]) for r in pairs] == [(1, 2, pytest.approx(4))]
    bow = codecs.geometry_column(spark.createDataFrame([("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))",)], "geom string"))
    assert bow.select(po.area(po.valid(F.col("geom_"))).alias("a")).first()["a"] == pytest.approx(2)
    line = codecs.geometry_column(spark.createDataFrame([("LINESTRING (0 0, 5 0.1, 10 0)",)], "geom string"))
    assert len(line.select(po.simplified(F.col("geom_"), 1.0).alias("g")).first()["g"]["parts"][0][0]) == 2
    p = zones.where("id = 1").select(po.inner_point(F.col("geom_")).alias("p")).first()["p"]
    assert 0 < p["x"] < 4 and 0 < p["y"] < 4


def test_discs_lines_and_masks(zones, spark):
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 50.0, 50.0), (3, 105.0, 5.0)], "id long, x double, y double")
    got = {r["id"]: r["area"] for r in po.disc_overlaps(points, zones.where("id <> 2"), 1.0, 50.0).collect()}
    assert got == {1: pytest.approx(math.pi), 2: 0.0, 3: pytest.approx(math.pi)}
    lines = codecs.geometry_column(spark.createDataFrame([(9, "LINESTRING (-2 1, 8 1)")], "id long, geom string")).drop("geom")
    assert [(r["r_id"], r["start"], r["end"]) for r in po.clipped_lines(lines, zones, 50.0).collect()] == [(1, 2.0, 6.0)]
    assert sorted(r["id"] for r in po.within_mask(points, zones, 50.0).collect()) == [1, 3]
