"""Polygon kernels, hulls, density clusters and projections."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.functions import projection as pr
from voltweave.operators import shapes

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
SHIFTED = [[(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]]
RING = [*SQUARE, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]


def test_boolean_areas():
    of = lambda a, b, op: shapes.area(shapes.combine(a, b, op))
    assert of([SQUARE], [SHIFTED], "intersection") == pytest.approx(4)
    assert of([SQUARE], [SHIFTED], "union") == pytest.approx(28)
    assert of([SQUARE], [SHIFTED], "difference") == pytest.approx(12)
    assert of([RING], [], "union") == pytest.approx(12)
    assert of([RING], [SHIFTED], "intersection") == pytest.approx(3)
    assert of([SQUARE, SHIFTED], [], "union") == pytest.approx(28)
    bow = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]
    assert of([bow], [], "union") == pytest.approx(2)
    assert of([], [], "union") == 0


def test_boolean_areas_of_random_triangles_by_sampling():
    rng = random.Random(2)
    for _ in range(5):
        a, b = ([[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]] for _ in range(2))
        hits = sum(shapes.contains(a, x, y) and shapes.contains(b, x, y) for x, y in ((rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(8000)))
        assert shapes.area(shapes.combine([a], [b], "intersection")) == pytest.approx(hits / 80, abs=1.5)


def test_disc_line_and_points():
    assert shapes.area(shapes.combine([shapes.disc(0, 0, 10)], [], "union")) == pytest.approx(math.pi * 100)
    assert shapes.line_inside([(-2.0, 2.0), (6.0, 2.0)], SQUARE) == [(2.0, 6.0)]
    assert shapes.line_inside([(-2.0, 2.0), (6.0, 2.0)], RING) == [(2.0, 3.0), (5.0, 6.0)]
    assert shapes.boundary_distance(SQUARE, 2, 1) == 1 and shapes.boundary_distance(SQUARE, 2, -3) == 3
    assert shapes.contains(RING, *shapes.inner_point(RING))
    assert shapes.simplify([(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)], 1.0) == [(0.0, 0.0), (10.0, 0.0)]


def test_hulls():
    grid = [(float(x), float(y)) for x in range(11) for y in range(11) if not (3 <= x <= 7 and y > 3)]
    convex, concave = shapes.convex_hull(grid), shapes.concave_hull(grid, 0.25)
    assert shapes.ring_area(convex) == 100
    assert 60 < shapes.ring_area(concave) < 90
    assert shapes.concave_hull([(0.0, 0.0), (1.0, 1.0)]) == [(0.0, 0.0), (1.0, 1.0)]


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_density_clusters(method):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal((0, 0), 1, (40, 2)), rng.normal((50, 0), 1, (30, 2)), [[25.0, 400.0]]])
    labels = shapes.hdbscan(points, 5 if method == "eom" else 10, 5, method)
    assert labels[-1] == -1
    first, second = labels[:40], labels[40:70]
    assert not set(first[first >= 0]) & set(second[second >= 0])
    if method == "eom":
        assert len(set(first)) == len(set(second)) == 1
    assert (shapes.hdbscan(points[:3], 5, 5) == -1).all()


@pytest.mark.parametrize("p", [pr.utm(19), pr.utm(55, south=True), pr.CONUS_ALBERS, pr.Lambert(-71.5, 41.0, 41.716666666666667, 42.683333333333333, 200000.0, 750000.0)])
def test_projections_round_trip(spark, p):
    south = isinstance(p, pr.TransverseMercator) and p.y0 > 0
    rows = spark.createDataFrame([(p.lon0 + dx, (-34.0 if south else 42.0) + dy) for dx in (-1.5, 0.0, 2.0) for dy in (0.0, 1.3)], "lon double, lat double")
    x, y = pr.forward(p, "lon", "lat")
    back = rows.withColumn("x", x).withColumn("y", y)
    lon, lat = pr.inverse(p, "x", "y")
    for r in back.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert (r["lon2"], r["lat2"]) == (pytest.approx(r["lon"], abs=2e-7), pytest.approx(r["lat"], abs=2e-7))


def test_projected_places(spark):
    rows = spark.createDataFrame([(-96.0, 23.0)], "lon double, lat double")
    x, y = pr.forward(pr.CONUS_ALBERS, "lon", "lat")
    r = rows.select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
    x, y = pr.forward(pr.utm(31), F.lit(3.0), F.lit(0.0))
    r = rows.select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (pytest.approx(500000), pytest.approx(0))
