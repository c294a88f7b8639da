"""Clustering of points and boxes by distance: dedup, DBSCAN, dense tiles, merging.

Neighbour pairs come from cell joins, or are met in blocks of cells; components from alternating stars. Nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.operators import spatial_join as sj
from voltweave.operators.components import connected_components
from voltweave.session import materialise


def tile_counts(points: DataFrame, tile: float) -> DataFrame:
    """i, j, n: points per square tile; a tile owns its lower and left border."""
    at = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("long")
    return points.groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"))


def dense_components(tiles: DataFrame, share: float, least: int) -> DataFrame:
    """i, j, component, size: tiles with counts above a percentile, in edge-connected components of at least so many tiles."""
    tiles = materialise(tiles, "tiles")
    limit = tiles.agg(F.percentile("n", F.lit(share))).first()[0]
    dense = tiles.where(F.col("n") > F.lit(limit))
    key = F.col("i") * 100000 + F.col("j")
    dense = materialise(dense.select("i", "j", key.alias("id")), "dense")
    right = dense.select((F.col("i") - 1).alias("i"), "j", F.col("id").alias("v"))
    above = dense.select("i", (F.col("j") - 1).alias("j"), F.col("id").alias("v"))
    edges = dense.join(right.union(above), ["i", "j"]).select(F.col("id").alias("u"), "v")
    named = dense.join(connected_components(edges), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    size = named.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return named.join(size, "component").select("i", "j", "component", "size")


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """u < v: ids of points at most radius apart."""
    boxed = sj.boxed_points(points.select("id", "x", "y"))
    pairs = sj.within_distance(boxed, boxed, radius, sj.point_distance())
    return pairs.where("l_id < r_id").select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def dedup_within(points: DataFrame, radius: float) -> DataFrame:
    """The row with the least id of each single-linkage group, and the group's members.

    Groups chain: members may be farther apart than radius, rows of different groups never are nearer. Number the rows by
    source priority first, so that the least id is the preferred source.
    """
    components = connected_components(near_pairs(points, radius))
    members = components.groupBy("component").agg(F.count("*").alias("members"))
    dropped = components.where("node <> component").select(F.col("node").alias("id"))
    kept = points.join(dropped, "id", "left_anti")
    return kept.join(members, F.col("id") == F.col("component"), "left").drop("component").withColumn("members", F.coalesce("members", F.lit(1)).cast("long"))


#: Cells of a side that one task of a density clustering owns.
BLOCK_CELLS = 32
#: How far neighbours lie, in cells whose diagonal is the radius: places of one cell are neighbours, and so each cell is one node.
_REACH = 2


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """points with cluster: the least core id of the cluster, -1 for noise. A border point joins its least neighbouring cluster.

    Points meet in blocks of cells whose diagonal is the radius, with the cells around, so no pair is written. A block joins its
    core cells; the blocks' groups are joined by the cells that they share.
    """
    kind = points.schema["id"].dataType.simpleString()
    side = radius / 2**0.5 * (1 - 1e-9)
    margin, block = 2 * _REACH, BLOCK_CELLS
    known = points.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = lambda c, d: F.floor((F.floor(F.col(c) / F.lit(side)) + d) / block)
    dealt = known.withColumn("_i", F.explode(F.sequence(at("x", -margin), at("x", margin)))).withColumn("_j", F.explode(F.sequence(at("y", -margin), at("y", margin))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _dense_block(pdf, int(key[0]) * block - margin, int(key[1]) * block - margin, block + 2 * margin, side, radius, least)

    found = materialise(dealt.groupBy("_i", "_j").applyInPandas(run, f"id {kind}, node long, core boolean, cell long"), "dbscan-blocks")
    shared = found.where("cell is not null")
    one = shared.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("cell", "least")
    edges = shared.join(one, "cell").where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    nodes = found.groupBy("node").agg(F.min(F.when(F.col("core"), F.col("id"))).alias("id")).join(connected_components(edges).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    nodes = materialise(nodes.select("node", "id", F.coalesce("component", "node").alias("component")), "dbscan-nodes")
    named = materialise(nodes.join(nodes.groupBy("component").agg(F.min("id").alias("cluster")), "component").select("node", "cluster"), "dbscan-labels")
    labels = found.where("core is not null").join(named, "node").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return points.join(labels, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("long"))


def _dense_block(pdf: pd.DataFrame, i0: int, j0: int, width: int, side: float, radius: float, least: int) -> pd.DataFrame:
    """Of the points in a block of cells: (id, node, core) for its own core points, (id, node, not core) for each group that one of
    its own other points borders on, and (node, cell) for each core cell. A node is a cell of the group.

    Twice _REACH cells around the block are known: which points are core is certain for all but the outer half of these.
    """
    li, lj = (np.floor(pdf[c].to_numpy() / side).astype(np.int64) - o for c, o in (("x", i0), ("y", j0)))
    order = np.argsort(li * width + lj, kind="stable")
    x, y, li, lj = pdf["x"].to_numpy()[order], pdf["y"].to_numpy()[order], li[order], lj[order]
    cell = li * width + lj
    count = np.bincount(cell, minlength=width * width)
    first = np.concatenate(([0], np.cumsum(count)))
    inside = lambda a, b, m: (a >= m) & (a < width - m) & (b >= m) & (b < width - m)

    def near(who: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1_000_000):
        """(a, b) of points and those within the radius of them, of those from begin to end, some at a time."""
        for p in range(0, len(who), 4096):
            w, lo, n = who[p : p + 4096], begin[p : p + 4096], (end - begin)[p : p + 4096]
            upto = np.cumsum(n)
            cuts = np.unique(np.searchsorted(upto, np.arange(most, int(upto[-1]), most))).tolist()
            for q, r in zip([0, *cuts], [*cuts, len(w)], strict=True):
                k = n[q:r]
                if k.sum():
                    b = np.arange(int(k.sum())) + np.repeat(lo[q:r] - (np.cumsum(k) - k), k)
                    a = np.repeat(w[q:r], k)
                    dx, dy = x[a] - x[b], y[a] - y[b]
                    hit = np.sqrt(dx * dx + dy * dy) <= radius
                    yield a[hit], b[hit]

    def around(who: np.ndarray):
        for d in range(-_REACH, _REACH + 1):
            row = (li[who] + d) * width + lj[who]
            yield from near(who, first[row - _REACH], first[row + _REACH + 1])

    core = count[cell] >= least
    asked = np.flatnonzero(~core & inside(li, lj, _REACH))
    met = np.zeros(len(x), np.int64)
    for a, _ in around(asked):
        met += np.bincount(a, minlength=len(x))
    core |= met >= least
    core &= inside(li, lj, _REACH)

    cores = np.flatnonzero(core)
    per = np.bincount(cell[cores], minlength=width * width)
    start = np.concatenate(([0], np.cumsum(per)))
    root = np.arange(width * width)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def touch(a: int, b: int) -> bool:
        """Whether a core point of one cell is near one of the other; of either only those near the other's box are tried."""
        p, q = (np.unique(np.column_stack([x[k], y[k]]), axis=0) for k in (cores[start[a] : start[a + 1]], cores[start[b] : start[b + 1]]))
        for _ in range(2):
            gap = np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0.0)
            p, q = q, p[(gap**2).sum(axis=1) <= radius * radius * (1 + 1e-9)]
            if not len(q):
                return False
        for k in range(0, len(p), 256):
            dx, dy = p[k : k + 256, None, 0] - q[None, :, 0], p[k : k + 256, None, 1] - q[None, :, 1]
            if (np.sqrt(dx * dx + dy * dy) <= radius).any():
                return True
        return False

    some = np.flatnonzero(per)
    ci, cj, own = some // width, some % width, inside(some // width, some % width, 2 * _REACH)
    offsets = [(di, dj) for di in range(_REACH + 1) for dj in range(-_REACH, _REACH + 1) if (di, dj) > (0, 0)]
    few = 4
    for di, dj in sorted(offsets, key=lambda d: d[0] ** 2 + d[1] ** 2):
        other = (ci + di) * width + cj + dj
        fits = inside(ci + di, cj + dj, _REACH)
        fits[fits] &= per[other[fits]] > 0
        fits[fits] &= own[fits] | inside(ci[fits] + di, cj[fits] + dj, 2 * _REACH)
        a, b = some[fits], other[fits]
        linked = np.zeros(len(a), bool)
        for k in range(few):  # the first points of both first: cells of many points mostly link by them
            for m in range(few):
                p, q = cores[start[a] + np.minimum(k, per[a] - 1)], cores[start[b] + np.minimum(m, per[b] - 1)]
                dx, dy = x[p] - x[q], y[p] - y[q]
                linked |= np.sqrt(dx * dx + dy * dy) <= radius
        for u, v in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
            root[find(u)] = find(v)
        rest = ~linked & ((per[a] > few) | (per[b] > few))
        for u, v in zip(a[rest].tolist(), b[rest].tolist(), strict=True):
            if find(u) != find(v) and touch(u, v):
                root[find(u)] = find(v)

    group = np.array([find(c) for c in range(width * width)])
    name = lambda c: (c // width + i0) * 2**32 + c % width + j0
    mine = inside(li, lj, 2 * _REACH)
    inner = np.flatnonzero(core & mine)
    out = [(order[inner], name(group[cell[inner]]), True)]
    for a, b in around(np.flatnonzero(~core & mine)):
        a, b = a[core[b]], b[core[b]]
        edge = np.unique(np.column_stack([a, group[cell[b]]]), axis=0)
        out.append((order[edge[:, 0]], name(edge[:, 1]), False))
    ids = pdf["id"]
    parts = [pd.DataFrame({"id": ids.iloc[at].to_numpy(), "node": node, "core": flag, "cell": None}) for at, node, flag in out if len(at)]
    parts.append(pd.DataFrame({"id": None, "node": name(group[some]), "core": None, "cell": name(some)}))
    whole = pd.concat([p for p in parts if len(p)] or parts, ignore_index=True)
    return whole.astype({"node": "Int64", "core": "boolean", "cell": "Int64"} | ({"id": "Int64"} if pd.api.types.is_integer_dtype(ids) else {}))


def building_clusters(buildings: DataFrame, radius: float, least: int, large: float, mega: float) -> DataFrame:
    """category, size_sqft, n, x, y: clusters with a large building, at that building; and very large buildings by themselves."""
    named = dbscan(buildings, radius, least)
    anchor = F.max_by(F.struct("x", "y"), F.struct("sqft", (-F.col("id")).alias("k")))
    groups = named.where("cluster >= 0").groupBy("cluster").agg(F.sum("sqft").alias("size_sqft"), F.count("*").alias("n"), F.max("sqft").alias("top"), anchor.alias("a"))
    groups = groups.where(F.col("top") >= large).select(F.lit("cluster").alias("category"), "size_sqft", "n", "a.x", "a.y")
    single = named.where((F.col("cluster") == -1) & (F.col("sqft") >= mega))
    return groups.unionByName(single.select(F.lit("mega_structure").alias("category"), F.col("sqft").alias("size_sqft"), F.lit(1).cast("long").alias("n"), "x", "y"))


def merge_boxes_within(boxes: DataFrame, gap: float) -> DataFrame:
    """Boxes at most gap apart, chained: least id, n, class mode, unweighted mean of val, common envelope."""
    dx = F.greatest(F.col("l_minx") - F.col("r_maxx"), F.col("r_minx") - F.col("l_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("l_miny") - F.col("r_maxy"), F.col("r_miny") - F.col("l_maxy"), F.lit(0.0))
    pairs = sj.box_pairs(boxes, boxes, max(200.0, gap), gap).where("l_id < r_id").where(F.sqrt(dx * dx + dy * dy) <= gap)
    named = boxes.join(connected_components(pairs, "l_id", "r_id"), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    return named.groupBy(F.col("component").alias("id")).agg(
        F.count("*").alias("n"), F.mode("cls", True).alias("cls"), F.avg("val").alias("mean_val"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )
