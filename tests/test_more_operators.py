"""Ranking without single-task windows, draws, healing, passes, volumes, sinks and boundaries against plain Python."""

from __future__ import annotations

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voltweave.functions import geometry as g
from voltweave.operators import clustering, components, learn, network, overlay, ranking, raster, sampling
from voltweave.operators import spatial_join as sj
from voltweave.plans import boundaries, catalogue, features, queries_graph
from voltweave.plans.layers import layer
from voltweave.sources import writers

SF = "/root/testdata/sf0.001"


def test_quantiles_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 2.5, rng.random()]), rng.gauss(0, 1), None) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = ranking.quantiles(df, ["a", "b", "c"], shares)
    for k, name in ((1, "a"), (2, "b")):
        assert got[name] == pytest.approx(np.quantile([r[k] for r in rows if r[k] is not None], shares).tolist())
    assert "c" not in got and ranking.quantiles(df.limit(0), ["a"], shares) == {}
    total = {r["id"]: r["t"] for r in ranking.running_totals(df, [F.col("id")], {"id": "t"}).collect()}
    assert total == {i: i * (i + 1) // 2 for i in range(700)}
    within = ranking.rank_within(df.selectExpr("id", "id % 3 as g"), "g", [F.col("id").desc()], "k").collect()
    assert {r["id"]: r["k"] for r in within} == {i: sum(1 for j in range(i + 1, 700) if j % 3 == i % 3) for i in range(700)}


def test_metrics_of_many_scores(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), rng.choice([1, 6])), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y int").repartition(4)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert learn.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc)
    ap = sum(sum(1 for p in pos if p == t) / len(pos) * sum(1 for p in pos if p >= t) / sum(1 for s, _ in rows if s >= t) for t in {s for s, _ in rows})
    assert learn.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)
    one = spark.createDataFrame([(0.5, 1)], "s double, y int")
    assert learn.roc_auc(one, "s", "y").first()[0] is None and learn.average_precision(one.limit(0), "s", "y").first()[0] is None


def test_samples_along_lines_are_exactly_as_many(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0), (3, 0.0, 100.0, 100.0, 100.0), (4, 0.0, 200.0, 1.0, 200.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    rows = sampling.along_lines(lines, 5000, 10.0).collect()
    assert sorted(r["k"] for r in rows) == list(range(5000))
    n = Counter(r["line_id"] for r in rows)
    assert 2 not in n and n[1] / 5000 == pytest.approx(1000 / 1101, abs=0.03) and n[3] / 5000 == pytest.approx(100 / 1101, abs=0.03)
    assert all(abs(r["y"] - {1: 0, 3: 100, 4: 200}[r["line_id"]]) <= 10 for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, sampling.along_lines(lines.repartition(3), 5000, 10.0).collect()))
    assert sampling.along_lines(lines.where("id = 2"), 7, 1.0).collect() == []
    with pytest.raises(ValueError):
        sampling.in_polygons(spark, spark.createDataFrame([(1, 0.0, 0.0, 1e-6, 1e-6), (2, 1e6, 1e6, 1e6 + 1e-6, 1e6 + 1e-6)], "id long, minx double, miny double, maxx double, maxy double"), 1)


def test_components_in_bounded_memory(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    want = {i: find(i) for e in edges for i in e if e[0] != e[1]}
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    monkeypatch.setattr(components, "SMALL", 0)
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(df)
    held = list(components._contract(iter([pd.DataFrame(edges[i : i + 20], columns=["u", "v"]) for i in range(0, 260, 20)])))
    assert len(held) == 1


def test_graph_of_three_passes(spark):
    rows = catalogue.queries()["edge_path_stats"](spark, SF).collect()
    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    n = len(parts)
    first: dict = {}
    for p in sorted(parts):
        for k, v in ((0, (p * 7 + 3) % n), (1, (p * 11 + 5) % n)):
            if p != v:
                first.setdefault((min(p, v), max(p, v)), (p * 2 + k, 1 + parts[p]["p_size"]))
                first[min(p, v), max(p, v)] = min(first[min(p, v), max(p, v)], (p * 2 + k, 1 + parts[p]["p_size"]))
    edges = {e: w for e, (_, w) in first.items()}
    assert {(r["u"], r["v"]): r["w"] for r in rows} == edges
    subs = {p for p, r in parts.items() if r["p_size"] == 50}
    clusters = {p for p, r in parts.items() if r["p_size"] == 7}

    def nearest(graph: dict, source: int, targets: set, k: int) -> list:
        at = defaultdict(list)
        for (u, v), w in graph.items():
            at[u].append((v, w))
            at[v].append((u, w))
        best, heap, out = {}, [(0.0, [source])], []
        while heap:
            dist, path = heapq.heappop(heap)
            if path[-1] in best:
                continue
            best[path[-1]] = dist
            if path[-1] in targets:
                out.append(path)
            for v, w in at[path[-1]]:
                if v not in best:
                    heapq.heappush(heap, (dist + w, [*path, v]))
        return out[:k]

    open_ = {e: w for e, w in edges.items() if w != 13}
    plan = [(1, edges, clusters, subs, 2, 0), (1, edges, clusters, clusters, 4, 1), (2, open_, clusters, subs, 2, 0), (2, open_, clusters, clusters, 3, 1)]
    plan.append((3, open_, {s for s in subs if s % 2}, {s for s in subs if s % 2 == 0}, 2, 0))
    count, ends = Counter(), defaultdict(set)
    for number, graph, sources, targets, k, itself in plan:
        for s in sources:
            for path in nearest(graph, s, targets, k + itself):
                for a, b in zip(path, path[1:]):
                    count[number, min(a, b), max(a, b)] += 1
                    ends[number, min(a, b), max(a, b)] |= {path[0], path[-1]}
    assert sum(count.values()) > 0
    for r in rows:
        for p in (1, 2, 3):
            key = (p, r["u"], r["v"])
            assert (r[f"p{p}_count"], r[f"p{p}_terminals"]) == (count[key], len(ends[key])), key
            cls = Counter(parts[t]["p_brand"] for t in ends[key])
            total = sum(cls.values())
            assert r[f"p{p}_entropy"] == pytest.approx(-sum(c / total * math.log2(c / total) for c in cls.values()) if total else 0.0, abs=1e-4)
            assert r[f"p{p}_mode"] == (min(cls, key=lambda c: (-cls[c], c)) if total else None)
        assert r["is_used_by_any_path"] == int(any(count[p, r["u"], r["v"]] for p in (1, 2, 3)))


def test_passes_look_for_as_many_clusters_as_a_run(spark, monkeypatch):
    asked, kept = [], network.passes
    monkeypatch.setattr(network, "passes", lambda *x: asked.append(kept(*x)) or asked[-1])
    rows = catalogue.queries()["edge_path_stats"](spark, "/root/testdata/sf0.01").collect()
    clusters = {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_size = 7").select("p_partkey").collect()}
    paths = asked[0].collect()
    at = defaultdict(set)
    for r in rows:
        at[r["u"]].add(r["v"])
        at[r["v"]].add(r["u"])

    def others(source: int) -> int:
        seen, todo = {source}, [source]
        while todo:
            new = at[todo.pop()] - seen
            seen |= new
            todo += new
        return len(seen & clusters) - 1

    found = Counter((r["pass"], r["source"]) for r in paths if r["pass"] < 3 and r["target"] in clusters)
    assert max(found.values()) > 4
    assert all(found[1, c] == min(25, others(c)) for c in clusters)
    for n in (1, 2, 3):
        steps = [(min(a, b), max(a, b), r["source"], r["target"]) for r in paths if r["pass"] == n for a, b in zip(r["path"], r["path"][1:])]
        count, ends = Counter(x[:2] for x in steps), defaultdict(set)
        for u, v, s, t in steps:
            ends[u, v] |= {s, t}
        assert {(r["u"], r["v"]): (r[f"p{n}_count"], r[f"p{n}_terminals"]) for r in rows} == {(r["u"], r["v"]): (count[r["u"], r["v"]], len(ends[r["u"], r["v"]])) for r in rows}


def test_healing_keeps_length_classes_and_protected_nodes(spark):
    rows = [(1, "a", "b", 1.0, "x", False), (2, "b", "c", 2.0, "x", True), (3, "c", "d", 3.0, "x", False), (4, "d", "e", 4.0, "y", False), (5, "e", "f", 5.0, "y", False), (6, "f", "f", 6.0, "y", False), (7, "g", "h", 1.0, None, False), (8, "h", "g", 1.0, None, False)]
    df = spark.createDataFrame(rows, "id long, a string, b string, len double, highway string, is_grid boolean")
    got = {r["id"]: (r["n"], r["len"], r["is_grid"]) for r in network.heal(df).collect()}
    assert got == {1: (3, 6.0, True), 4: (2, 9.0, False), 6: (1, 6.0, False), 7: (2, 2.0, False)}
    kept = network.heal(df, spark.createDataFrame([("c",), ("e",)], "node string"))
    assert {r["id"]: r["n"] for r in kept.collect()} == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}


def test_stitched_lengths_add_up(spark):
    parts = [r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    rows = catalogue.queries()["degree2_stitch"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == len(parts) and len({r["stitched_id"] for r in rows}) == len(rows)
    assert all(r["n"] == 1 or r["len"] <= 60 for r in rows) and any(r["n"] > 1 for r in rows)


def test_edge_usage_counts_the_paths(spark):
    paths = queries_graph._paths(spark, SF).collect()
    want, ends = Counter(), defaultdict(set)
    for r in paths:
        for a, b in zip(r["path"], r["path"][1:]):
            want[min(a, b), max(a, b)] += 1
            ends[min(a, b), max(a, b)] |= {r["source"], r["target"]}
    got = {(r["u"], r["v"]): (r["path_count"], r["terminals"]) for r in catalogue.queries()["edge_usage"](spark, SF).collect()}
    assert got == {e: (n, len(ends[e])) for e, n in want.items()} and got


def test_training_points_are_balanced(spark):
    rows = catalogue.queries()["training_points"](spark, SF).collect()
    n = Counter(r["label"] for r in rows)
    assert n[0] == n[1] > 20 and len({r["point_id"] for r in rows}) == len(rows)
    lines = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in layer(spark, SF, "v_lines").collect()]

    def gap(x, y):
        out = []
        for x1, y1, x2, y2 in lines:
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            out.append(math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        return min(out)

    assert all(r["label"] == int(gap(r["x"], r["y"]) <= r["buffer_m"]) for r in rows)
    assert all(100 <= r["buffer_m"] <= 450 for r in rows)


def test_folds_cover_all_rows(spark):
    oof = catalogue.queries()["gbt_oof"](spark, SF).collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert len(oof) == len({r["o_orderkey"] for r in oof}) == orders and {r["fold"] for r in oof} == {0, 1}
    assert all(0 <= r["y_proba"] <= 1 for r in oof) and {r["y_true"] for r in oof} == {0, 1}
    folds = catalogue.queries()["kmeans_folds"](spark, SF).collect()
    assert {r["fold"] for r in folds} == set(range(5)) and len({r["id"] for r in folds}) == len(folds)


def test_synthetic_links_span_their_zones(spark):
    rows = catalogue.queries()["synthetic_links"](spark, SF).collect()
    assert rows


def test_volumes_and_networks_are_written(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 2, 5.0, 1.0), (9, 0, 2, 7.0, None), (3, 4, 0, 1.0, 2.0), (4, 4, 3, 1.0, 1.0), (5, None, 1, 1.0, 1.0)], "id long, row long, col long, a double, b double")
    vol = raster.volume(cells, ["a", "b"], 3)
    want = {("a", 0): [0.0, 0.0, 7.0], ("a", 4): [1.0, 0.0, 0.0], ("b", 4): [2.0, 0.0, 0.0]}
    assert {(r["channel"], r["row"]): r["values"] for r in vol.collect()} == want
    writers.write_tensor(vol, f"{tmp_path}/t", {"cols": 3, "rows": 5})
    back, meta = writers.read_tensor(spark, f"{tmp_path}/t")
    assert {(r["channel"], r["row"]): r["values"] for r in back.collect()} == want and meta == {"cols": 3, "rows": 5}


def test_boundaries_by_name(spark):
    layer = spark.createDataFrame([("Iowa", 1), ("IOWA ", 2), ("Ohio", 3)], "State_Name string, k int")
    assert {r["k"] for r in boundaries.named_rows(layer, "iowa").collect()} == {1, 2}
    assert [r["k"] for r in boundaries.named_rows(layer, "Iowa", exact=True).collect()] == [1]
    with pytest.raises(ValueError):
        boundaries.named_rows(layer, "Utah")
    with pytest.raises(ValueError):
        boundaries.named_rows(layer.select("k"), "Iowa")


def test_exports(spark):
    p = spark.createDataFrame([(1, 0, 1, 0.5)], "id long, fold int, y_true int, y_proba double")
    g = spark.createDataFrame([(1, "here"), (2, "there")], "id long, geom string")
    assert learn.export(p, g, "id", oof=True).columns == ["id", "geom", "fold", "y_true", "y_proba"]
    assert learn.export(p, g, "id", geo=False).columns == ["id", "y_proba"] and learn.export(p, g, "id").count() == 1


def test_the_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_a_boundary_is_the_union_of_its_rows(spark):
    from voltweave.sources import codecs

    square = lambda x, y, s: f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"
    rows = [("Iowa", square(0, 0, 4)), ("iowa", square(2, 2, 4)), ("Ohio", square(100, 0, 10))]
    states = codecs.geometry_column(spark.createDataFrame(rows, "NAME string, geom string")).drop("geom")
    mask = boundaries.boundary(states, "IOWA")
    assert [(r["name"], r["n"], r["area"]) for r in mask.collect()] == [("IOWA", 2, pytest.approx(28))]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 5.0, 1.0), (4, 105.0, 5.0)], "id long, x double, y double")
    assert {r["id"] for r in boundaries.clipped(points, mask, 10.0).collect()} == {1, 2}


def test_nearest_targets_by_source_and_by_rounds_equal_brute_force(spark, monkeypatch):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 3, 1.0), (3, 5, 2.0), (5, 6, 0.5), (2, 6, 9.0), (None, 1, 1.0), (1, 6, None), (7, 8, 1.0)]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    sources = spark.createDataFrame([(1,), (3,), (8,), (9,), (1,)], "source long")
    targets = spark.createDataFrame([(3,), (6,), (5,), (9,), (7,)], "target long")
    expected = [(1, 3, 2.0, [1, 2, 3]), (1, 5, 4.0, [1, 2, 3, 5]), (3, 3, 0.0, [3]), (3, 5, 2.0, [3, 5]), (8, 7, 1.0, [8, 7]), (9, 9, 0.0, [9])]
    for held in (network.HELD_EDGES, 0):
        monkeypatch.setattr(network, "HELD_EDGES", held)
        assert sorted(tuple(r) for r in network.nearest_targets(df, sources, targets, 2).collect()) == expected


def test_radius_count_equals_brute_force(spark):
    left = [(i, (i * 37 % 101) * 3.5 - 100, (i * 53 % 97) * 3.0) for i in range(60)] + [(60, None, 1.0), (61, 0.0, 0.0)]
    right = [((i * 29 % 89) * 4.0 - 100, (i * 71 % 103) * 2.5) for i in range(400)] + [(30.0, 40.0), (50.0, 0.0), (None, 0.0)]
    out = sj.radius_count(spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "x double, y double"), 50.0)
    expected = {i: sum(x is not None and a is not None and ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= 50 for a, b in right) for i, x, y in left}
    assert {r["id"]: r["n"] for r in out.collect()} == expected


def test_a_disc_that_is_missed_covers_nothing(spark):
    rows = [(0.0, 0.0, 10.0, 0.0, 5.0, 9.0), (0.0, 0.0, 10.0, 0.0, 5.0, 3.0), (0.0, 0.0, 10.0, 0.0, 50.0, 0.0), (1.0, 1.0, 1.0, 1.0, 2.0, 1.0), (1.0, 1.0, 1.0, 1.0, 20.0, 1.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, px double, py double")
    lo, hi = g.capsule_interval("x1", "y1", "x2", "y2", "px", "py", 5.0)
    assert [tuple(r) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()] == [(None, None), (0.1, 0.9), (None, None), (0.0, 1.0), (None, None)]


def test_radius_count_adds_up_over_chunks_of_a_dense_block(spark, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_ROWS", 300)
    rng = random.Random(4)
    spots = lambda n: [(float(rng.randrange(90)), float(rng.randrange(90))) for _ in range(n)]
    left, right = [(i, *p) for i, p in enumerate(spots(80))], spots(2000)
    out = sj.radius_count(spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "x double, y double"), 25.0)
    expected = {i: sum(((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= 25 for a, b in right) for i, x, y in left}
    assert {r["id"]: r["n"] for r in out.collect()} == expected


def test_nearest_looks_into_narrow_cells_where_rows_are_dense(spark):
    rng = random.Random(5)
    spots = lambda: sj.boxed_points(spark.createDataFrame([(i, rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(600)], "id long, x double, y double"))
    tested = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def apart(ax, ay, bx, by):
        tested.add(1)
        return ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5

    a, b = spots(), spots()
    near = sj.k_nearest(a, b, cell=500.0, d=lambda: apart("l_x", "l_y", "r_x", "r_y")).collect()
    n, want = tested.value, b.collect()
    for r in a.collect():
        best = min(want, key=lambda q: ((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2, q["id"]))
        assert [x["r_id"] for x in near if x["l_id"] == r["id"]] == [best["id"]]
    assert n < 60_000  # 360,000 pairs in all


def test_depth_areas_count_every_unit_square(spark, monkeypatch):
    monkeypatch.setattr(overlay, "LATTICE_CELLS", 200)
    rng = random.Random(6)
    boxes = [(float(x := rng.randrange(-20, 60)), float(y := rng.randrange(-20, 60)), float(x + rng.randrange(20)), float(y + rng.randrange(20))) for _ in range(150)]
    depth = Counter((i, j) for a, b, c, e in boxes for i in range(int(a), int(c)) for j in range(int(b), int(e)))
    got = overlay.depth_areas(spark.createDataFrame(boxes, "minx double, miny double, maxx double, maxy double"), 25.0).collect()
    assert {r["n"]: r["area"] for r in got} == Counter(depth.values())


def test_boxes_much_wider_than_a_cell_lie_in_few_cells(spark):
    boxes = spark.createDataFrame([(float(i), float(i), i + 8000.0, i + 8000.0) for i in range(50)], "minx double, miny double, maxx double, maxy double")
    cell = sj.fitting_cell(boxes, 500.0)
    assert sj._cells(boxes, "", cell, 0.0).count() <= 50 * 4
    assert sj.fitting_cell(boxes.limit(0), 500.0) == 500.0


def test_held_places_give_the_nearest_distance(spark):
    rng = np.random.default_rng(5)
    clumped = np.concatenate([rng.normal(0, 1, (300, 2)), [[500.0, 500.0]], np.zeros((40, 2))])
    p = np.concatenate([rng.normal(0, 3, (200, 2)), rng.uniform(-900, 900, (100, 2))])
    for q in (clumped, rng.uniform(0, 50, (500, 2)), np.column_stack([np.arange(50.0), np.zeros(50)]), np.array([[3.0, 4.0]]), clumped[:0]):
        got = sj.Places(q[:, 0], q[:, 1]).nearest(p[:, 0], p[:, 1], most=1000)
        want = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min(axis=1) if len(q) else np.full(len(p), np.nan)
        assert np.array_equal(got, want, equal_nan=True)
    units = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 6.0, 8.0)], "id long, x double, y double")
    layers = {"a": spark.createDataFrame([(0.0, 0.0), (None, 1.0)], "x double, y double"), "b": units.select("x", "y").limit(0)}
    out = features.distances(units, layers)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0.0, None), (2, None, None), (3, 10.0, None)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def _plain_dbscan(p, radius, least):
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= radius
    core, label = near.sum(axis=1) >= least, np.full(len(p), -1)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            k = todo.pop()
            if label[k] < 0:
                label[k] = i
                todo += np.flatnonzero(near[k] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return dict(enumerate(label.tolist()))


def test_dbscan_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_CELLS", 5)
    monkeypatch.setattr(clustering, "near_pairs", None)  # pairs grow with the square of the density: none may be written
    rng = np.random.default_rng(7)
    for p, radius, least in (
        (rng.uniform(-60, 60, (500, 2)), 5.0, 3),
        (rng.integers(0, 40, (700, 2)).astype(float), 2.0, 8),
        (np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(9, 2, (80, 2)), np.column_stack([np.linspace(-80, 80, 150), np.zeros(150)])]), 2.5, 4),
        (np.concatenate([rng.uniform(0, 1.3, (60, 2)), rng.uniform(0, 1.3, (60, 2)) + [2.2, 0]]), 1.0, 2),
        (rng.uniform(0, 90, (60, 2)), 3.0, 1),
    ):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(9999, None, 1.0)], "id long, x double, y double")
        got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, radius, least).collect()}
        assert got == _plain_dbscan(p, radius, least) | {9999: -1}


def test_merged_intervals_equal_those_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    p = rng.integers(-60, 60, (150, 2)).astype(float)
    segs = [(i, *p[i].tolist(), *(p[i] + (rng.integers(-50, 50, 2) if i % 9 else [0, 30] if i % 2 else [0, 0])).tolist()) for i in range(150)]
    segs = sj.boxed_segments(spark.createDataFrame([*segs, (999, None, 0.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double"))
    c, h = rng.integers(-60, 60, (120, 2)), rng.choice([0, 3, 9, 40], (120, 2), p=[0.1, 0.5, 0.37, 0.03])
    boxes = spark.createDataFrame([tuple(map(float, (*(c[i] - h[i]), *(c[i] + h[i])))) for i in range(120)], "minx double, miny double, maxx double, maxy double")
    lines = segs.where("id % 4 = 0")
    pairs = overlay.segment_box_intervals(segs, boxes, 20.0), overlay.segment_buffer_intervals(segs, lines, 6.0, 20.0)
    monkeypatch.setattr(overlay, "TESTED", 500)
    monkeypatch.setattr(sj, "box_pairs", None)  # pairs grow with the product of the densities: none may be written
    merged = overlay.merged_intervals(segs, boxes, overlay.box_clips, 25.0), overlay.merged_intervals(segs, lines, overlay.buffer_clips(6.0), 25.0, 6.0)
    monkeypatch.setattr(overlay, "SAMPLED", 1.0)
    dense = overlay.merged_intervals(segs, boxes, overlay.box_clips, 30.0), overlay.merged_intervals(segs, lines, overlay.buffer_clips(6.0), 30.0, 6.0)
    for a, b in zip(pairs * 2, merged + dense, strict=True):
        share = [{r["id"]: round(r["share"], 9) for r in overlay.union_share(x, "id").collect()} for x in (a, b)]
        assert share[0] and share[0] == share[1]
        gaps = [sorted(tuple(r) for r in overlay.cut_outside(segs, x, "id", 0.7).collect()) for x in (a, b)]
        assert len(gaps[0]) == len(gaps[1]) and np.allclose(gaps[0], gaps[1], rtol=0, atol=1e-12)


def test_network_edges_are_those_of_all_pairs(spark, monkeypatch):
    edges = lambda: sorted(tuple(r) for r in catalogue.queries()["network_edges"](spark, SF).collect())
    pairs, boxes = overlay.segment_box_intervals, []
    got = edges()
    monkeypatch.setattr(overlay, "merged_intervals", lambda segs, zones, *_: boxes.append(1) or pairs(segs, zones, 500.0))
    assert got and got == edges() and boxes


def test_one_search_for_several_kinds_of_targets_equals_one_search_each(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 61, float(1 + i % 4)) for i in range(61)] + [(i, (i * 11 + 5) % 61, float(1 + i % 4)) for i in range(61)], "u long, v long, w double").where("u <> v")
    sources, odd, few = (spark.createDataFrame([(x,) for x in xs], f"{c} long") for c, xs in (("source", [0, 7, 14, 90]), ("target", [1, 7, 21, 90]), ("target", [5, 14])))
    expected = sorted((k, *r) for k, (t, n) in enumerate(((odd, 3), (few, 1))) for r in map(tuple, network.nearest_targets(edges, sources, t, n).collect()))
    assert (0, 90, 90, 0.0, [90]) in expected and len(expected) == 13
    for held in (network.HELD_EDGES, 0):
        monkeypatch.setattr(network, "HELD_EDGES", held)
        (got,) = network.nearest_of_each(edges, [(sources, [(odd, 3), (few, 1)])])
        assert sorted(map(tuple, got.collect())) == expected


def test_pruning_links_in_blocks_equals_links_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    rows = [(int(i), float(a), float(b), float(a + c), float(b + e)) for i, a, b, c, e in zip(rng.permutation(500) + 100, x, y, rng.integers(-30, 31, 500), rng.integers(-30, 31, 500), strict=True)]
    rows += [(1, 50.0, 50.0, None, 60.0), (2, None, 50.0, None, 60.0), (3, 900.0, 900.0, 902.0, 900.0), (4, 906.0, 900.0, 2900.0, 900.0), (5, 2905.0, 900.0, 2905.0, 905.0)]
    segs = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    pairs = [(r["l_id"], r["r_id"]) for r in network.touching_pairs(segs, 5.0, 50.0).collect()]
    root = {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for a in root:
        groups.setdefault(find(a), []).append(a)
    expected = sorted((a, k, len(v)) for k, v in groups.items() if len(v) >= 3 for a in v)
    assert len(groups) > 10 and (5, 3, 3) in expected
    monkeypatch.setattr(network, "connected_components", lambda links, *ends, real=network.connected_components: real(links, *ends) if links.count() < len(pairs) / 4 else pytest.fail("pairs are written"))
    for sample in (40.0, 0.05):
        monkeypatch.setattr(network, "LINK_SAMPLE", sample)
        assert sorted((r["id"], r["component"], r["size"]) for r in network.prune(segs, 5.0, 3, 50.0).collect()) == expected


def test_cutting_in_blocks_equals_cutting_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    rows = [(i, float(a), float(b), float(a + c), float(b + e), f"c{i % 3}") for i, (a, b, c, e) in enumerate(zip(x, y, rng.integers(-40, 41, 200), rng.integers(-40, 41, 200), strict=True))]
    rows += [(900, 500.0, 500.0, 500.0, 520.0, "a"), (901, 490.0, 510.0, 510.0, 510.0, None), (902, 480.0, 500.0, 500.0, 500.0, "b"), (903, None, 1.0, 2.0, 3.0, "n")]
    segs = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, highway string")
    blocks = {tuple(r) for r in network.planarise(segs, 50.0).select("id", "piece", "t0", "t1", "x1", "y2", "len", "highway").collect()}
    monkeypatch.setattr(network, "CUT_WIDEST", -1.0)
    pairs = {tuple(r) for r in network.planarise(segs, 50.0).select("id", "piece", "t0", "t1", "x1", "y2", "len", "highway").collect()}
    assert blocks == pairs and len(blocks) > 300 and {(r[0], r[2], r[3]) for r in blocks if r[0] >= 900} == {(900, 0.0, 0.5), (900, 0.5, 1.0), (901, 0.0, 0.5), (901, 0.5, 1.0), (902, 0.0, 1.0)}
    monkeypatch.undo()
    monkeypatch.setattr(network, "crossings", lambda *_: pytest.fail("crossings are written"))
    assert network.planarise(segs, 50.0).count() == len(blocks)
