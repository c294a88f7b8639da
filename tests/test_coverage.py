"""Covers: what they are sure of, and that with them the results are those of all shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltweave.operators import coverage, overlay
from voltweave.operators import spatial_join as sj


def _layers(spark, n: int, m: int, seed: int):
    rng = np.random.default_rng(seed)
    ends = rng.uniform(0, 1000, (n, 2)).round()
    off = rng.integers(-60, 61, (n, 2))
    off[:5] = 0
    segs = pd.DataFrame({"id": range(n), "x1": ends[:, 0], "y1": ends[:, 1], "x2": ends[:, 0] + off[:, 0], "y2": ends[:, 1] + off[:, 1]}).astype({"id": "int64"})
    at, h = rng.uniform(100, 800, (m, 2)).round(), rng.integers(5, 40, m)
    boxes = pd.DataFrame({"id": range(m), "minx": at[:, 0] - h, "miny": at[:, 1] - h, "maxx": at[:, 0] + h, "maxy": at[:, 1] + h}).astype(float)
    lines = pd.DataFrame({"id": range(m), "x1": at[:, 0], "y1": at[:, 1], "x2": at[:, 0] + rng.integers(-60, 61, m), "y2": at[:, 1] + rng.integers(-60, 61, m)}).astype(float)
    unknown = spark.createDataFrame([(n, 400.0, 400.0, None, None), (n + 1, None, 1.0, None, 2.0), (n + 2, float("nan"), 1.0, 5.0, 2.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    return sj.boxed_segments(spark.createDataFrame(segs).unionByName(unknown)), spark.createDataFrame(boxes), sj.boxed_segments(spark.createDataFrame(lines))


@pytest.mark.parametrize("kind", ["boxes", "lines"])
def test_open_intervals_cover_what_all_others_cover(spark, kind):
    segs, boxes, lines = _layers(spark, 500, 1500, 3)
    others, radius = (boxes, 0.0) if kind == "boxes" else (lines, 15.0)
    clips = overlay.box_clips if kind == "boxes" else overlay.buffer_clips(radius)
    cover = coverage.box_cover(boxes, 4.0) if kind == "boxes" else coverage.buffer_cover(lines, radius, 4.0, free=True)
    left, parts = overlay.open_intervals(segs, others, cover, clips, 200.0, radius)
    want = overlay.merged_intervals(segs, others, clips, 200.0, radius)
    some = left.select("id").toPandas()["id"]
    share = overlay.union_share(want, "id").toPandas().set_index("id")["share"]
    assert 0 < len(some) < 350  # the rest is answered by the cover
    assert share[~share.index.isin(some)].to_numpy() == pytest.approx(1.0) and (~share.index.isin(some)).sum() == 503 - len(some)
    got = overlay.union_share(parts, "id").toPandas().set_index("id")["share"]
    assert got.to_dict() == pytest.approx(share[share.index.isin(some)].to_dict())
    near = coverage.near_uncovered(others, left.where("x1 between 0 and 120 and id < 500"), cover, radius)
    assert 0 < near.count() < 1000
    gaps = lambda s, i: {tuple(r) for r in overlay.cut_outside(s, i, "id", 0.5).select("id", F.round("lo", 6), F.round("hi", 6)).collect()}
    assert gaps(left, parts) == gaps(segs.where("id < 503"), want)


def test_shares_bound_what_is_covered(spark):
    segs, _, lines = _layers(spark, 400, 60, 5)
    cover = coverage.buffer_cover(lines, 15.0, 4.0, free=True)
    found = coverage.with_shares(segs, cover, "low", "high").join(overlay.union_share(overlay.merged_intervals(segs, lines, overlay.buffer_clips(15.0), 200.0, 15.0), "id"), "id", "left").na.fill(0.0, ["share"]).toPandas()
    assert (found["low"] <= found["share"] + 1e-9).all() and (found["share"] <= found["high"] + 1e-9).all()
    assert (found["high"] == 0).any() and (found["low"] > 0.5).any() and (found["high"] - found["low"]).mean() < 0.5


def test_covers_of_no_shapes_and_wide_planes(spark):
    segs, boxes, _ = _layers(spark, 50, 20, 7)
    assert coverage.box_cover(boxes.where("id < 0"), 4.0) is None
    assert coverage.uncovered(segs, None).count() == 53
    far = boxes.unionByName(spark.createDataFrame([(99.0, 9e8, 9e8, 9e8 + 5, 9e8 + 5)], boxes.schema))
    cover = coverage.box_cover(far, 4.0)
    assert cover.grid.nx * cover.grid.ny < 1.1 * coverage.CELLS + 1e5 and coverage.uncovered(segs, cover).count() == 53
