"""Hand-computed cases of the geometry, attribute, network and sampling functions."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from voltweave.functions import geometry as g
from voltweave.functions import scalar as s
from voltweave.operators import aggregate, clustering, components, learn, network, overlay, preprocess, ranking, raster, sampling
from voltweave.operators import spatial_join as sj

LINE = "array<struct<x:double,y:double>>"


def one(spark, value, **columns):
    df = spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items())) if columns else spark.range(1)
    return df.select(value.alias("v")).first()["v"]


def line(*xy):
    return ([{"x": float(x), "y": float(y)} for x, y in xy], LINE)


def test_curvature(spark):
    c = g.curvature("l")
    assert one(spark, c, l=line((0, 0), (100, 0), (100, 100))) == pytest.approx(math.pi / 2 / 200)
    assert one(spark, c, l=line((0, 0), (5, 5))) == 0
    assert one(spark, c, l=line((0, 0), (50, 0), (50, 0), (100, 0), (100, 100))) == pytest.approx(math.pi / 2 / 200)


def test_measures(spark):
    square = line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    assert one(spark, g.ring_area("r"), r=square) == 16
    assert one(spark, g.line_length("r"), r=square) == 16
    assert tuple(one(spark, g.ring_centroid("r"), r=square)) == (2, 2)
    assert tuple(one(spark, g.line_centroid("l"), l=line((0, 0), (10, 0)))) == (5, 0)
    assert one(spark, g.point_in_ring(F.lit(1.0), F.lit(1.0), "r"), r=square) is True
    assert one(spark, g.point_in_ring(F.lit(5.0), F.lit(1.0), "r"), r=square) is False
    assert one(spark, g.ring_area("r"), r=line((0, 0), (1, 1))) == 0


def test_union_of_overlaps_is_not_a_sum(spark):
    segs = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([(1, 20.0, -1.0, 40.0, 1.0), (2, 30.0, -1.0, 60.0, 1.0)], "id long, minx double, miny double, maxx double, maxy double")
    iv = overlay.segment_box_intervals(sj.boxed_segments(segs), boxes, 50.0)
    assert overlay.union_share(iv, "id").first()["share"] == pytest.approx(0.4)
    parts = overlay.cut_outside(segs, iv, "id", 0.5).orderBy("lo").collect()
    assert [(round(r["lo"], 6), round(r["hi"], 6)) for r in parts] == [(0.0, 0.2), (0.6, 1.0)]
    assert overlay.cut_outside(segs, iv, "id", 0.39).collect() == []


def test_buffer_of_a_line_covers_what_is_near(spark):
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], schema)
    b = spark.createDataFrame([(1, 40.0, 3.0, 60.0, 3.0)], schema)
    iv = overlay.segment_buffer_intervals(sj.boxed_segments(a), sj.boxed_segments(b), 5.0, 50.0)
    assert overlay.union_share(iv, "id").first()["share"] == pytest.approx((20 + 2 * 4) / 100)


def test_convex_clip():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert overlay.area(overlay.clip_convex([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], square)) == pytest.approx(4)
    assert overlay.clip_convex([(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)], square) == []


def test_voltages(spark):
    keep = lambda v: one(spark, s.keep_voltage("v"), v=(v, "string"))
    assert [keep(v) for v in ("69000", "", None, "13800;69000", "low")] == [False, True, True, True, True]
    kv = lambda v, m: one(spark, s.voltage_kv("v", "m"), v=(v, "string"), m=(m, "double"))
    assert (kv("115000;69000", None), kv("abc", 69.0), kv("115000; 69kV", None), kv(None, 0.0)) == (115.0, 69.0, 115.0, None)


def test_attributes(spark):
    assert one(spark, s.utilities("n"), n=("Joint Eversource / National  Grid/ ", "string")) == ["EVERSOURCE", "NATIONAL GRID"]
    assert one(spark, s.highway_class("h"), h=("['Primary', 'x']", "string")) == "primary"
    assert one(spark, s.highway_class("h"), h=(None, "string")) == "other"
    assert one(spark, s.highway_class("h"), h=("motorway", "string")) == "other"
    tags = ({"landuse": "cemetery"}, "map<string,string>")
    assert one(spark, s.tags_match("t", {"amenity": ["grave_yard"], "landuse": ["cemetery"]}), t=tags) is True
    assert one(spark, s.tags_match("t", {"landuse": True}), t=tags) is True
    assert one(spark, s.tags_match("t", {"amenity": True}), t=tags) is False
    assert [one(spark, s.utm_epsg(F.lit(x), F.lit(y))) for x, y in ((-71.0, 42.0), (151.0, -34.0))] == [32619, 32756]
    assert one(spark, s.number("v"), v=("x1", "string")) is None
    assert one(spark, s.finite("v"), v=(float("inf"), "double")) is None
    assert one(spark, s.tile_size("v"), v=("250_tiles", "string")) == 250


def test_node_and_edge_ids(spark):
    assert one(spark, network.node_id(F.lit(2.5), F.lit(3.5))) == "N_2_4"
    edges = spark.createDataFrame([(1, "N_9_0", "N_10_0"), (2, "N_10_0", "N_9_0")], "row_id long, u string, v string")
    assert sorted(r["edge_id"] for r in network.with_edge_ids(edges).collect()) == ["E_N_10_0_N_9_0", "E_N_10_0_N_9_0_p1"]
    parallel = spark.createDataFrame([(1, 1, 2, "service"), (2, 2, 1, "primary"), (3, 1, 2, "primary")], "row_id long, u long, v long, highway string")
    assert [r["row_id"] for r in network.dedupe_parallel(parallel).collect()] == [2]
    weights = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 1, 3.0), (3, 4, 4, 1.0)], "row_id long, u long, v long, w double")
    assert [tuple(r) for r in network.simple_graph(weights).collect()] == [(1, 2, 5.0)]


def test_chains(spark):
    schema = "id long, a string, b string, len double, highway string, name string"
    chain = lambda sizes: spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", float(x), "service", None) for i, x in enumerate(sizes)], schema)
    got = lambda sizes: sorted(r["len"] for r in network.stitch(chain(sizes), 3500.0).collect())
    assert got([1000, 1500, 1200]) == [1200, 2500]
    assert got([2000, 2000]) == [2000, 2000]
    assert got([100]) == [100]
    assert network.split_points(8000, [], 5000, 3500, 500) == [3500, 7000]
    assert network.split_points(4900, [], 5000, 3500, 500) == []
    assert network.split_points(8000, [3000, 300, 5200], 5000, 3500, 500) == [3000, 5200]


def test_nearest_targets_counts_the_source_itself(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (1, 4, 10.0)], "u long, v long, w double")
    sources, targets = spark.createDataFrame([(1,)], "source long"), spark.createDataFrame([(1,), (4,)], "target long")
    got = lambda n: [tuple(r) for r in network.nearest_targets(edges, sources, targets, n).orderBy("dist").collect()]
    assert got(1) == [(1, 1, 0.0, [1])]
    assert got(2) == [(1, 1, 0.0, [1]), (1, 4, 6.0, [1, 2, 3, 4])]


def test_nearest_targets_equal_dijkstra(spark):
    rng = random.Random(4)
    edges = [(u, rng.randrange(60), float(rng.randint(1, 9))) for u in range(60) for _ in range(2)]
    edges = list({(min(u, v), max(u, v)): (min(u, v), max(u, v), w) for u, v, w in edges if u != v}.values())
    near: dict = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    targets = set(range(0, 60, 7))

    def brute(source: int) -> list[float]:
        done, heap, found = set(), [(0.0, source)], []
        while heap and len(found) < 3:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x in targets:
                found.append(d)
            for y, w in near.get(x, []):
                heapq.heappush(heap, (d + w, y))
        return found

    rows = network.nearest_targets(spark.createDataFrame(edges, "u long, v long, w double"), spark.range(0, 60, 11).toDF("source"), spark.createDataFrame([(t,) for t in targets], "target long"), 3).collect()
    for source in range(0, 60, 11):
        assert sorted(r["dist"] for r in rows if r["source"] == source) == brute(source)


def test_components_are_least_members_in_any_order(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(400) if i % 50] + [(1000, x) for x in range(1001, 1200)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert all(got[i] == (i - 1) // 50 * 50 + 1 for i in range(1, 401) if i in got)
    assert all(got[i] == 1000 for i in range(1000, 1200))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_dedup_chains_and_dbscan(spark):
    at = lambda xs: spark.createDataFrame([(i, float(x), 0.0, 1.0) for i, x in enumerate(xs)], "id long, x double, y double, sqft double")
    assert sorted(r["x"] for r in clustering.dedup_within(at([0, 40, 80, 200]), 50.0).collect()) == [0, 200]
    assert [r["cluster"] for r in clustering.dbscan(at([0, 150, 300, 1000]), 200.0, 3).orderBy("id").collect()] == [1, 1, 1, -1]


def test_cell_join_equals_nested_loop(spark):
    rng = random.Random(9)
    rows = lambda n: [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(n)]
    a, b = rows(80), rows(60)
    make = lambda x: sj.boxed_points(spark.createDataFrame(x, "id long, x double, y double"))
    want = {(p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= 120}
    for cell in (50.0, 120.0, 400.0):
        got = [(r["l_id"], r["r_id"]) for r in sj.within_distance(make(a), make(b), 120.0, sj.point_distance(), cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {(r["l_id"], r["rank"]): r["r_id"] for r in sj.k_nearest(make(a), make(b), k=2, cell=20.0).collect()}
    for p in a:
        order = sorted(b, key=lambda q: (math.dist(p[1:], q[1:]), q[0]))
        assert (near[p[0], 1], near[p[0], 2]) == (order[0][0], order[1][0])


def test_terrain_slope_of_a_plane(spark):
    plane = spark.range(36).select((F.col("id") / 6).cast("long").alias("row"), (F.col("id") % 6).alias("col"), (F.col("id") % 6 * 3.0).alias("v"))
    assert all(r["slope"] == pytest.approx(5.7106, abs=1e-4) for r in raster.slope(plane, 6, 6, 30.0).collect())


def test_scaling_roundtrip_and_application(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, None), (2, 2.0, 1.0, None), (3, 3.0, 0.0, None), (4, 10.0, 1.0, None)], "id long, a_pct double, flag double, empty double")
    fitted = preprocess.Scaling.fit(df, ["a_pct", "flag", "empty"])
    assert fitted.classes == {"a_pct": "pct", "flag": "binary", "empty": "binary"}
    assert [round(r["a_pct"], 4) for r in fitted.apply(df, ["id"]).orderBy("id").collect()] == [-0.5, -0.1667, 0.1667, 2.5]
    assert preprocess.Scaling.from_json(fitted.to_json()) == fitted
    assert fitted.apply(df.select("id"), ["id"]).first()["a_pct"] == pytest.approx(-2.5 / 3)


def test_folds_keep_ties_together(spark):
    lat = lambda xs: [r["fold"] for r in learn.strip_folds(spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, lat double"), "lat", 2).orderBy("id").collect()]
    assert lat([1, 2, 3, 4]) == [0, 0, 1, 1]
    assert lat([1, 1, 1, 2]) == [1, 1, 1, 1]


def test_buffers_entropy_and_weights(spark):
    width = lambda n: one(spark, aggregate.interpolated(F.lit(n), 0, 600, 450.0, 100.0))
    assert [width(n) for n in (0, 300, 600, 900)] == [450, 275, 100, 100]
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "a")], "k long, c string")
    assert sorted(tuple(r) for r in aggregate.mode_and_entropy(rows, "k", "c").collect()) == [(1, "a", 1.0), (2, "a", 0.0)]
    parcels = spark.createDataFrame([(10.0, 1.0), (None, 5.0), (30.0, 3.0)], "v double, w double")
    assert parcels.agg(aggregate.weighted_mean("v", "w")).first()[0] == 25


def test_ranks_and_patches(spark):
    rows = spark.createDataFrame([(x,) for x in "dbace"], "k string")
    assert [(r["k"], r["n"]) for r in ranking.dense_rank_global(rows, [F.col("k")], "n").orderBy("n").collect()] == [(c, i) for i, c in enumerate("abcde")]
    ids = sampling.renumbered(rows, [F.col("k")], "road_id", "R_%06d").orderBy("k").first()["road_id"]
    assert ids == "R_000000"
    tiles = spark.range(64).select((F.col("id") / 8).cast("long").alias("row"), (F.col("id") % 8).alias("col"))
    parts = spark.createDataFrame([(0, 0, "val"), (0, 1, "train"), (1, 0, "train"), (1, 1, "train")], "br long, bc long, part string")
    got = {(r["r0"], r["c0"]): r["part"] for r in sampling.patches(tiles, 8, 8, 4, 2, 0.4, block=4, parts=parts).collect()}
    assert got[(0, 0)] == "val" and got[(4, 4)] == "train" and (0, 2) not in got
