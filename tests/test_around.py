"""Statistics around points, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.operators import around
from voltweave.operators import spatial_join as sj
from voltweave.plans import catalogue, features


@pytest.mark.parametrize("tested", [around.TESTED, 50])
def test_kernel_equals_brute_force(monkeypatch, tested):
    monkeypatch.setattr(around, "TESTED", tested)
    rng = np.random.default_rng(2)
    for n, m, wide, values in ((200, 900, 60.0, 1e5), (300, 40, 60.0, 3), (50, 2000, 8.0, 1e5), (40, 500, 60.0, 1), (30, 1, 5.0, 9), (1, 7, 5.0, 2), (300, 3, 200.0, 9)):
        px, py, x, y = (rng.uniform(0, wide, k).round() for k in (n, n, m, m))
        v = rng.integers(0, values, m) / 7 + 1e4
        if m == 900:
            v[3], v[5] = np.inf, np.nan
        px[0] = np.nan if n > 1 else px[0]
        box = [rng.uniform(0, wide, 30).round() for _ in range(2)]
        box = [*box, box[0] + 9, box[1] + 5, rng.uniform(0, 9, 30)]
        count, (med, std, total), (held,) = around.around(px, py, x, y, v, 10.0, box, 1)
        for i in range(n):
            near = v[np.sqrt((x - px[i]) ** 2 + (y - py[i]) ** 2) <= 10.0]
            assert count[i] == len(near)
            with np.errstate(invalid="ignore"):
                order = np.sort(near)
                want = [(order[(len(near) - 1) // 2] + order[len(near) // 2]) / 2 if len(near) else np.nan, np.std(near, ddof=1) if len(near) > 1 else np.nan, near.sum() if len(near) else np.nan]
            assert [med[i], std[i], total[i]] == pytest.approx(want, rel=1e-9, abs=1e-7, nan_ok=True)
            assert held[i] == pytest.approx(box[4][(box[0] <= px[i]) & (px[i] <= box[2]) & (box[1] <= py[i]) & (py[i] <= box[3])].sum())


def test_building_stats_write_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = lambda n: [tuple(map(float, p)) for p in rng.integers(0, 300, (n, 2))]
    units = spark.createDataFrame([(i, *p) for i, p in enumerate(at(200))] + [(900, None, 1.0), (901, 5000.0, 1.0)], "id long, x double, y double")
    homes = spark.createDataFrame([(i, *p, float(i * 7919 % 500) / 4 if i % 11 else None) for i, p in enumerate(at(400))] + [(900, 1.0, None, 3.0)], "id long, x double, y double, sqft double")
    pairs = sj.within_distance(sj.boxed_points(units), sj.boxed_points(homes), 25.0, sj.point_distance())
    from voltweave.operators import aggregate

    want = units.select("id").join(aggregate.size_stats(pairs, "l_id", "r_sqft").toDF("id", *features.BUILDINGS), "id", "left").na.fill(0).collect()
    monkeypatch.setattr(sj, "box_pairs", None)  # pairs grow with the square of the density: none may be written
    got = features.building_stats(units, homes, 25.0, "sqft").collect()
    assert len(got) == 202 and {r["id"]: pytest.approx(tuple(r)[1:], abs=1e-9) for r in want} == {r["id"]: tuple(r)[1:] for r in got}


def test_road_features_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(sj, "box_pairs", None)
    monkeypatch.setattr(sj, "within_distance", None)
    rows = catalogue.queries()["road_features"](spark, "/root/testdata/sf0.001").agg(F.count("*"), F.count_distinct("id"), F.sum("bldg_n")).first()
    assert rows[0] == rows[1] == 1500 and rows[2] >= 1500
