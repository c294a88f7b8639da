"""Road and grid networks: ids, adjacency, cleaning, noding, stitching, shortest paths and their use.

Edge tables have u, v and a row_id that stands for the order in which a single machine would meet them; every "first wins" rule
is a rule about row_id. Chains of unbounded length are walked by component, each of which is one chain.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.functions import geometry as g
from voltweave.operators import aggregate, overlay
from voltweave.operators import spatial_join as sj
from voltweave.operators.components import connected_components
from voltweave.session import materialise, release

# ---------------------------------------------------------------- ids and tables


def node_id(x: Column | str, y: Column | str) -> Column:
    """N_<x>_<y> with coordinates rounded half to even."""
    return F.format_string("N_%d_%d", F.rint(g.col(x)).cast("long"), F.rint(g.col(y)).cast("long"))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """edge_id E_<lo>_<hi> of the ends sorted as strings; the N-th parallel edge by row_id gets _pN."""
    pair = F.array_sort(F.array(F.col("u").cast("string"), F.col("v").cast("string")))
    base = F.concat_ws("_", F.lit("E"), pair[0], pair[1])
    n = F.row_number().over(Window.partitionBy("_base").orderBy("row_id")) - 1
    out = edges.withColumn("_base", base).withColumn("_n", n)
    return out.withColumn("edge_id", F.when(F.col("_n") > 0, F.concat(F.col("_base"), F.lit("_p"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def node_table(edges: DataFrame) -> DataFrame:
    """node, connected_edges, connected_nodes: sorted lists joined by a comma and a blank; loops don't make a neighbour."""
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e"))
    ends = ends.select("edge_id", "e.node", "e.other")
    other = F.when(F.col("other") != F.col("node"), F.col("other").cast("string"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return ends.groupBy("node").agg(joined("edge_id").alias("connected_edges"), joined(other).alias("connected_nodes"))


#: Which road class of two parallel edges stays: the smaller number; unknown classes come last (fixed values).
PRIORITY = {"primary": 1, "secondary": 2, "tertiary": 3, "residential": 4, "service": 5}
UNKNOWN_PRIORITY = 99


def class_priority(cls: Column, priority: dict[str, int]) -> Column:
    out = F.lit(UNKNOWN_PRIORITY)
    for name, rank in priority.items():
        out = F.when(cls == name, rank).otherwise(out)
    return out


def dedupe_parallel(edges: DataFrame, priority: dict[str, int] | None = None, cls: str = "highway") -> DataFrame:
    """One edge per unordered pair of ends: the best class, the first row among equals."""
    rank = class_priority(F.col(cls), priority or PRIORITY)
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy(rank, "row_id")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def simple_graph(edges: DataFrame, weight: str = "w") -> DataFrame:
    """u < v, w: loops dropped, of parallel edges the weight of the first row."""
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    return edges.where("u <> v").select(*pair, "row_id", weight).groupBy("u", "v").agg(F.min_by(weight, "row_id").alias("w"))


def first_positive(*columns: str) -> Column:
    """The first of several length columns that is above 0."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in columns])


# ---------------------------------------------------------------- cleaning


def segment_ends(segs: DataFrame) -> DataFrame:
    """Two rows per segment: id, end (0 or 1), x, y, and the boxes for joins."""
    ends = F.array(*[F.struct(F.lit(i).alias("end"), F.col(f"x{i + 1}").alias("x"), F.col(f"y{i + 1}").alias("y")) for i in (0, 1)])
    return sj.boxed_points(segs.select("id", F.explode(ends).alias("e")).select("id", "e.end", "e.x", "e.y"))


def remove_stubs(segs: DataFrame, classes: list[str], shorter: float, reach: float, cell: float) -> DataFrame:
    """Drops short segments of some classes unless both ends are within reach of another segment."""
    short = F.col("highway").isin(*classes) & (g.segment_length() < shorter)
    candidates = segs.where(short)
    ends = segment_ends(candidates)
    touch = sj.within_distance(ends, sj.boxed_segments(segs), reach, sj.point_line_distance(), cell).where("l_id <> r_id")
    ends = ends.join(touch.select(F.col("l_id").alias("id"), F.col("l_end").alias("end"), F.lit(True).alias("hit")).distinct(), ["id", "end"], "left")
    dead = ends.groupBy("id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("both")).where("not both")
    return segs.join(dead, "id", "left_anti")


def touching_pairs(segs: DataFrame, reach: float, cell: float) -> DataFrame:
    boxed = sj.boxed_segments(segs.select("id", "x1", "y1", "x2", "y2"))
    return sj.box_pairs(boxed, boxed, cell, reach).where("l_id < r_id").where(g.segments_near("l_", "r_", reach))


#: Width of the blocks in which touching segments meet, in cells, and candidates of a segment in the sample that is tried first.
LINK_BLOCK, LINK_SAMPLE = 5, 40.0
_ENDS = ("x1", "y1", "x2", "y2")


def prune(segs: DataFrame, reach: float, least: int, cell: float) -> DataFrame:
    """Keeps the segments of components, linked within reach, of at least so many segments; a lone segment is one of size 1."""
    rows = materialise(touching_groups(segs, reach, LINK_BLOCK * cell), "prune-blocks")
    several = rows.where("shared").select("id", "root").withColumn("m", F.min("root").over(Window.partitionBy("id")))
    links = materialise(several.where("root <> m").select("root", "m").distinct(), "prune-links")
    linked = connected_components(links, "root", "m")
    own = rows.where("own").join(linked, F.col("root") == F.col("node"), "left").select("id", F.coalesce("component", "root").alias("component"))
    own = own.groupBy("id").agg(F.min("component").alias("component"))
    named = segs.join(own.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    size = named.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return named.join(size, "component")


def touching_groups(segs: DataFrame, reach: float, block: float) -> DataFrame:
    """id, root, shared, own: for each block that a segment, widened by reach, touches, the least id of those that it is linked
    with there; whether it touches other blocks too, and whether the block is the one it is named in.

    Any two segments within reach have a block in common, and links are never written. A segment with a null in one end is only
    its other end; one with nulls in both is linked with nothing and has no rows.
    """
    half = lambda i: F.col(f"x{i}").isNull() | F.col(f"y{i}").isNull()
    ends = segs.select("id", *[F.when(half(c[1]), F.col(c[0] + str(3 - int(c[1])))).otherwise(F.col(c)).cast("double").alias(c) for c in _ENDS]).where("id is not null")
    for c in _ENDS:
        ends = ends.where(F.col(c).isNotNull() & ~F.isnan(c))
    at = lambda x, d: F.floor((x + F.lit(d)) / F.lit(float(block)))
    low, high = [F.least(f"{c}1", f"{c}2") for c in "xy"], [F.greatest(f"{c}1", f"{c}2") for c in "xy"]
    # a trifle wider than reach, as the test of nearness may round up
    span = {f"{n}{c}": at(x, s * (reach * (1 + 1e-6) + 1e-6)) for c, lo, hi in zip("ij", low, high, strict=True) for n, x, s in (("a", lo, -1), ("b", hi, 1))}
    dealt = ends.withColumns(span).withColumn("shared", (F.col("ai") < F.col("bi")) | (F.col("aj") < F.col("bj")))
    dealt = dealt.withColumn("_i", F.explode(F.sequence("ai", "bi"))).withColumn("_j", F.explode(F.sequence("aj", "bj")))
    dealt = dealt.select("_i", "_j", "id", *_ENDS, "shared", ((F.col("_i") == F.col("ai")) & (F.col("_j") == F.col("aj"))).alias("own"))
    kind = segs.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)  # the least place of a group is the least id
        root = linked_groups({c: pdf[c].to_numpy(float) for c in _ENDS}, reach)
        return pd.DataFrame({"id": pdf["id"], "root": pdf["id"].iloc[root].reset_index(drop=True), "shared": pdf["shared"], "own": pdf["own"]})

    return dealt.groupBy("_i", "_j").applyInPandas(run, f"id {kind}, root {kind}, shared boolean, own boolean")


def linked_groups(segs: dict[str, np.ndarray], reach: float) -> np.ndarray:
    """The least place of the segments that each is linked with, in a chain of any length, of which each is within reach of the next.

    Ever larger samples are tried first, by crossings alone, for the segments outside the largest group found so far. These are
    asked nothing more; all others meet all.
    """
    n = len(segs["x1"])
    root, todo = np.arange(n), np.arange(n)
    some = lambda at: {c: v[at] for c, v in segs.items()}
    width, height = (np.abs(segs[f"{c}2"] - segs[f"{c}1"]) for c in "xy")
    area = max((segs["x1"].max() - segs["x1"].min()) * (segs["y1"].max() - segs["y1"].min()), 1.0)
    step = int(n * (2 * width.mean() + 1) * (2 * height.mean() + 1) / area / LINK_SAMPLE)
    while step > 1:
        sample = np.arange(0, n, step)
        for who, at in overlay.candidates(some(todo), some(sample), 0.0, True):
            hit = _sides(some(todo[who]), some(sample[at]))
            root = _joined(root, todo[who][hit], sample[at][hit])
        todo = np.flatnonzero(root != np.bincount(root).argmax())
        step //= 6
    for who, at in overlay.candidates(some(todo), segs, reach, True):
        hit = _near(some(todo[who]), some(at), reach)
        root = _joined(root, todo[who][hit], at[hit])
    return root


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least place of each group, after the links of a with b."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up


def _sides(a: dict, b: dict) -> np.ndarray:
    """Whether paired segments cross, each with its ends on both sides of the other."""
    out = np.ones(len(a["x1"]), bool)
    for p, q in ((a, b), (b, a)):
        dx, dy = q["x2"] - q["x1"], q["y2"] - q["y1"]
        one, two = ((p[f"x{i}"] - q["x1"]) * dy - (p[f"y{i}"] - q["y1"]) * dx for i in (1, 2))
        out &= one * two < 0
    return out


def _near(a: dict, b: dict, reach: float) -> np.ndarray:
    """functions.geometry.segments_near of paired rows, in arrays."""
    square, out = reach * reach, _sides(a, b)
    for p, q in ((a, b), (b, a)):
        dx, dy = q["x2"] - q["x1"], q["y2"] - q["y1"]
        long = dx * dx + dy * dy
        for i in (1, 2):
            ex, ey = p[f"x{i}"] - q["x1"], p[f"y{i}"] - q["y1"]
            dot, cross = ex * dx + ey * dy, ex * dy - ey * dx
            out |= (dot > 0) & (dot < long) & (cross * cross <= square * long)
    for i in (1, 2):
        for j in (1, 2):
            ex, ey = a[f"x{i}"] - b[f"x{j}"], a[f"y{i}"] - b[f"y{j}"]
            out |= ex * ex + ey * ey <= square
    return out


def crossings(segs: DataFrame, cell: float) -> DataFrame:
    """id, other, t: the share of each segment at which another one crosses it inside."""
    boxed = sj.boxed_segments(segs)
    pairs = sj.box_pairs(boxed, boxed, cell).where("l_id <> r_id").where(g.segments_cross("l_", "r_"))
    return pairs.select(F.col("l_id").alias("id"), F.col("r_id").alias("other"), g.crossing_share("l_", "r_").alias("t"))


#: Width of the blocks in which segments are cut, in cells; a layer with a segment wider than so many blocks is cut by pairs instead,
#: with the same result.
CUT_BLOCK, CUT_WIDEST = 1, 2.0


def planarise(segs: DataFrame, cell: float, least: float = 0.005) -> DataFrame:
    """Cuts segments at every crossing: id, piece, t0, t1, x1 to y2 and the segment's columns; pieces of at most least metres go.

    A segment is cut in the block of its middle, where it meets all that come near enough, so no crossing is written or shuffled.
    """
    wide = segs.agg(F.max(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 0.0
    pieces = _cut_in_blocks(segs, float(CUT_BLOCK * cell), float(wide)) if wide <= CUT_WIDEST * CUT_BLOCK * cell else _cut_by_pairs(segs, cell)
    start, end = g.interpolate("x1", "y1", "x2", "y2", F.col("t0")), g.interpolate("x1", "y1", "x2", "y2", F.col("t1"))
    pieces = pieces.withColumns({"_a": start, "_b": end, "len": (F.col("t1") - F.col("t0")) * g.segment_length()}).where(F.col("len") > least)
    return pieces.withColumns({"x1": F.col("_a.x"), "y1": F.col("_a.y"), "x2": F.col("_b.x"), "y2": F.col("_b.y")}).drop("_a", "_b")


def _cut_by_pairs(segs: DataFrame, cell: float) -> DataFrame:
    cuts = crossings(segs, cell).groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    whole = segs.join(cuts, "id", "left")
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))))
    pieces = whole.withColumn("ts", ts).select("*", F.posexplode(F.slice("ts", 1, F.size("ts") - 1)).alias("piece", "t0"))
    return pieces.withColumn("t1", F.element_at("ts", F.col("piece") + 2)).drop("ts", "cuts")


def _cut_in_blocks(segs: DataFrame, block: float, wide: float) -> DataFrame:
    """segs with piece, t0 and t1. Segments with a null or NaN end cross nothing, and are whole."""
    sound = F.lit(True)
    for c in _ENDS:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    at = lambda c, d: F.floor(((F.col(f"{c}1") + F.col(f"{c}2")) / 2 + F.lit(d)) / F.lit(block))
    known = segs.where(sound)
    left = known.withColumns({"_i": at("x", 0.0), "_j": at("y", 0.0)})
    reach = wide * (1 + 1e-9) + 1e-6  # two segments that meet have their middles at most this far apart either way
    right = known.select(F.col("id").alias("other"), *[F.col(c).cast("double").alias(c) for c in _ENDS], F.explode(F.sequence(at("x", -reach), at("x", reach))).alias("_i"), at("y", -reach).alias("_a"), at("y", reach).alias("_b"))
    right = right.withColumn("_j", F.explode(F.sequence("_a", "_b"))).select("other", *_ENDS, "_i", "_j")

    names = segs.columns

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:  # no segment has its middle here
            return pd.DataFrame(columns=[*names, "piece", "t0", "t1"])
        ours, others = ({c: df[c].to_numpy(float) for c in _ENDS} for df in (a, b))
        who, piece, t0, t1 = cut_places(ours, others, a["id"].to_numpy(), b["other"].to_numpy())
        return a.drop(columns=["_i", "_j"]).iloc[who].reset_index(drop=True).assign(piece=piece, t0=t0, t1=t1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segs.schema)
    cut = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(run, f"{fields}, piece int, t0 double, t1 double")
    return cut.unionByName(segs.where(~sound).withColumns({"piece": F.lit(0), "t0": F.lit(0.0), "t1": F.lit(1.0)}))


def cut_places(segs: dict[str, np.ndarray], others: dict[str, np.ndarray], own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of segments, piece, t0, t1: the pieces between a segment's crossings with others of another id."""
    n = len(own)
    whose, share = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
    for who, at in overlay.candidates(segs, others, 0.0, True):
        ax, ay, bx, by = segs["x1"][who], segs["y1"][who], others["x1"][at], others["y1"][at]
        rx, ry, sx, sy = segs["x2"][who] - ax, segs["y2"][who] - ay, others["x2"][at] - bx, others["y2"][at] - by
        d = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = ((bx - ax) * sy - (by - ay) * sx) / d, ((bx - ax) * ry - (by - ay) * rx) / d
        hit = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        hit[hit] = own[who[hit]] != ids[at[hit]]
        whose.append(who[hit])
        share.append(t[hit])
    whose, share = np.concatenate(whose), np.concatenate(share)
    order = np.lexsort((share, whose))
    whose, share = whose[order], share[order]
    fresh = np.append(True, (whose[1:] != whose[:-1]) | (share[1:] != share[:-1]))
    whose, share = whose[fresh], share[fresh]
    begin = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
    piece = np.arange(len(whose)) - np.repeat(begin, np.diff(begin, append=len(whose)))
    first = np.flatnonzero(whose[1:] == whose[:-1])
    return whose[first], piece[first].astype(np.int32), share[first], share[first + 1]


def split_points(length: float, junctions: list[float], most: float, step: float, clear: float) -> list[float]:
    """Where a line longer than most is cut: each time at the farthest junction in (at + clear, at + step], else at at + step."""
    cuts: list[float] = []
    if length <= most:
        return cuts
    at = 0.0
    while length - at > step:
        near = [j for j in junctions if at + clear < j <= at + step and j < length]
        at = max(near) if near else at + step
        cuts.append(at)
    return cuts


def split_long(lines: DataFrame, most: float, step: float, clear: float, length: str = "length", junctions: str = "junctions") -> DataFrame:
    """Explodes each line into its pieces: piece, start, end along the line. The scan is greedy, so it runs in an Arrow function."""

    @F.pandas_udf("array<double>")
    def cuts(n: pd.Series, js: pd.Series) -> pd.Series:
        return pd.Series([split_points(a, sorted(b) if b is not None else [], most, step, clear) for a, b in zip(n, js, strict=True)], dtype=object)

    at = F.concat(F.array(F.lit(0.0)), F.col("_cuts"), F.array(F.col(length)))
    out = lines.withColumn("_cuts", cuts(F.col(length), F.col(junctions))).withColumn("_at", at)
    out = out.select("*", F.posexplode(F.slice("_at", 1, F.size("_at") - 1)).alias("piece", "start"))
    return out.withColumn("end", F.element_at("_at", F.col("piece") + 2)).drop("_cuts", "_at")


def _walk(most: float, unlimited: tuple[str, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One chain: walks from the free end of the lowest segment, cutting where the running length would exceed most."""
        pdf = pdf.sort_values("id").reset_index(drop=True)
        at: dict = {}
        for i, r in enumerate(pdf.itertuples()):
            at.setdefault(r.a, []).append(i)
            at.setdefault(r.b, []).append(i)
        free = [i for i, r in enumerate(pdf.itertuples()) if len(at[r.a]) == 1 or len(at[r.b]) == 1]
        i = free[0] if free else 0
        node = pdf["a"][i] if len(at[pdf["a"][i]]) == 1 else pdf["b"][i] if free else pdf["a"][i]
        seen, part, run_length, out = set(), 0, 0.0, []
        while i is not None:
            seen.add(i)
            size = float(pdf["len"][i])
            if out and run_length + size > most and pdf["highway"][i] not in unlimited:
                part, run_length = part + 1, 0.0
            run_length += size
            out.append((int(pdf["component"][i]), part, len(out), int(pdf["id"][i]), size))
            node = pdf["b"][i] if pdf["a"][i] == node else pdf["a"][i]
            i = next((j for j in at[node] if j not in seen), None)
        return pd.DataFrame(out, columns=["component", "part", "place", "id", "len"])

    return run


def stitch(edges: DataFrame, most: float, unlimited: tuple[str, ...] = ("osm_grid",)) -> DataFrame:
    """Merges chains of edges through nodes of two ends, of one class and name: stitched_id (its first edge), n, len, part.

    A chain is cut where its running length would exceed most, unless its class is exempt. Edges: id, a, b, len, highway, name.
    """
    ends = edges.select("id", "highway", "name", F.explode(F.array("a", "b")).alias("node"))
    two = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("u"), F.max("id").alias("v"), F.count_distinct("highway").alias("classes"), F.min("highway").alias("cls"), F.count_distinct("name").alias("names"), F.count("name").alias("named"))
    same = (F.col("names") <= 1) & F.col("named").isin(0, 2) | F.col("cls").isin(*unlimited)
    links = two.where((F.col("n") == 2) & (F.col("u") != F.col("v")) & (F.col("classes") == 1) & same).select("u", "v")
    named = edges.join(connected_components(links), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    kept = named.join(links.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi")
    walked = kept.select("component", "id", "a", "b", "len", "highway").groupBy("component").applyInPandas(_walk(most, unlimited), "component long, part int, place int, id long, len double")
    single = named.join(links.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_anti").select("component", F.lit(0).alias("part"), F.lit(0).alias("place"), "id", "len")
    both = walked.unionByName(single)
    return both.groupBy("component", "part").agg(F.min_by("id", "place").alias("stitched_id"), F.count("*").alias("n"), F.sum("len").alias("len"))


def heal(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Merges chains through nodes of two ends of one class, however long: id (the least of its edges), n, len, is_grid, highway.

    Nodes in `protected` (node) are kept. A merged edge is of the grid if one of its parts is. Chains are components of the
    links at such nodes, so no chain is gathered into one task. Edges: id, a, b, len, highway, is_grid.
    """
    ends = edges.select("id", "highway", F.explode(F.array("a", "b")).alias("node"))
    two = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("u"), F.max("id").alias("v"), F.count_distinct("highway").alias("classes"), F.count("highway").alias("with_class"))
    links = two.where("n = 2 and u <> v and classes <= 1 and with_class in (0, 2)")
    if protected is not None:
        links = links.join(protected.select("node").distinct(), "node", "left_anti")
    named = edges.join(connected_components(links.select("u", "v")), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    return named.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.bool_or("is_grid").alias("is_grid"), F.min("highway").alias("highway"))


# ---------------------------------------------------------------- paths


#: Undirected edges up to which each task holds the whole graph, in arrays of 40 bytes an edge, and searches its sources one by
#: one; beyond it all sources advance in rounds of joins, with the same result.
HELD_EDGES = 4_000_000
#: Tasks for each core into which the sources of a search are dealt: some sources see far more of the graph than others.
SEARCH_TASKS = 4


def nearest_targets(edges: DataFrame, sources: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """source, target, dist, path: the n nearest targets of each source; the source itself counts if it is a target.

    Ties go to the lexicographically smaller path. edges: u, v, w (undirected, w > 0); sources: source; targets: target. A graph
    of at most HELD_EDGES edges is broadcast, and sources are spread over tasks; a larger one stays distributed. Edges with a
    null end or weight don't exist.
    """
    return nearest_of_each(edges, [(sources, [(targets, n)])])[0].drop("kind")


def nearest_of_each(edges: DataFrame, searches: list[tuple[DataFrame, list[tuple[DataFrame, int]]]]) -> list[DataFrame]:
    """For each search, its sources and some kinds of targets with their n: kind (from 0), source, target, dist, path.

    Every kind's rows are those of nearest_targets; a source looks for all kinds in one search, over one graph.
    """
    known = materialise(edges.where("u is not null and v is not null and w is not null").select("u", "v", F.col("w").cast("double").alias("w")), "paths-edges")
    few = known.count() <= HELD_EDGES
    graph = _held_graph(known) if few else None
    out = []
    for sources, kinds in searches:
        goals = [targets.select(F.col("target").alias("v")).where("v is not null").distinct() for targets, _ in kinds]
        flags = goals[0].withColumn("goals", F.lit(1))
        for k, goal in enumerate(goals[1:], 1):
            flags = flags.unionByName(goal.withColumn("goals", F.lit(1 << k)))
        flags = materialise(flags.groupBy("v").agg(F.sum("goals").alias("goals")), "paths-goals")
        starts = sources.select(F.col("source").alias("v")).where("v is not null").distinct().join(flags, "v", "left").select(F.col("v").alias("source"), F.coalesce("goals", F.lit(0)).alias("goals"))
        counts = [n for _, n in kinds]
        if few and flags.count() <= 2 * HELD_EDGES:
            out.append(_nearest_by_source(graph, flags, starts, counts))
            continue
        whole = None
        for k, n in enumerate(counts):
            goal = flags.where(F.col("goals").bitwiseAND(1 << k) > 0).select("v", F.lit(True).alias("goal"))
            marked = known.union(known.select("v", "u", "w")).join(goal, "v", "left").select("u", "v", "w", F.coalesce("goal", F.lit(False)).alias("goal"))
            found = _nearest_by_rounds(materialise(marked, "paths-marked"), starts.select("source", (F.col("goals").bitwiseAND(1 << k) > 0).alias("goal")), n)
            found = found.select(F.lit(k).alias("kind"), "source", "target", "dist", "path")
            whole = found if whole is None else whole.unionByName(found)
        out.append(whole)
    return out


def _held_graph(known: DataFrame) -> tuple[np.ndarray, Broadcast]:
    """The nodes in order, and a broadcast of them and of each one's neighbours: where its own begin, places in nodes, weights."""
    rows = known.toArrow()
    u, v, w = (rows[c].to_numpy() for c in ("u", "v", "w"))
    del rows
    nodes = np.union1d(np.unique(u), np.unique(v))
    u, v = (np.searchsorted(nodes, x).astype(np.int32) for x in (u, v))
    ends = np.concatenate((u, v))
    order = np.argsort(ends, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=len(nodes)))))
    other, weight = np.concatenate((v, u))[order], np.concatenate((w, w))[order]
    return nodes, known.sparkSession.sparkContext.broadcast((nodes, first, other, weight))


def _nearest_by_source(graph: tuple[np.ndarray, Broadcast], flags: DataFrame, starts: DataFrame, counts: list[int]) -> DataFrame:
    """nearest_of_each by a search from each source over a broadcast graph of checked size."""
    nodes, held = graph
    rows = flags.toArrow()
    targets, bits = rows["v"].to_numpy(), rows["goals"].to_numpy()
    mask = np.zeros(len(nodes), np.int64)
    if len(nodes) and len(targets):
        at = np.minimum(np.searchsorted(nodes, targets), len(nodes) - 1)
        some = nodes[at] == targets
        mask[at[some]] = bits[some]
    context = flags.sparkSession.sparkContext
    marked = context.broadcast(mask)

    def search(batches):
        nodes, first, other, weight = held.value
        mask = marked.value
        for pdf in batches:
            out = []
            for source, own in zip(pdf["source"].tolist(), pdf["goals"].tolist(), strict=True):
                left = list(counts)
                at = int(np.searchsorted(nodes, source))
                if at == len(nodes) or nodes[at] != source:  # no edge leads away
                    out += [(k, source, source, 0.0, [source]) for k, n in enumerate(left) if n > 0 and own >> k & 1]
                    continue
                heap, best, settled = [(0.0, (at,))], {at: (0.0, (at,))}, set()
                while heap and max(left) > 0:  # paths end in their node and tell equal distances apart
                    dist, path = heapq.heappop(heap)
                    node = path[-1]
                    if node in settled:
                        continue
                    settled.add(node)
                    if kinds := int(mask[node]):
                        for k, n in enumerate(left):
                            if n > 0 and kinds >> k & 1:
                                out.append((k, source, nodes[node], dist, nodes[list(path)]))
                                left[k] -= 1
                    a, b = first[node], first[node + 1]
                    for to, w in zip(other[a:b].tolist(), weight[a:b].tolist(), strict=True):
                        if to not in settled:
                            known = best.get(to)
                            if known is None or dist + w <= known[0]:
                                step = (dist + w, (*path, to))
                                if known is None or step < known:
                                    best[to] = step
                                    heapq.heappush(heap, step)
            yield pd.DataFrame(out, columns=["kind", "source", "target", "dist", "path"])

    kind = starts.schema["source"].dataType.simpleString()
    return starts.repartition(SEARCH_TASKS * context.defaultParallelism, "source").mapInPandas(search, f"kind int, source {kind}, target {kind}, dist double, path array<{kind}>")


def _nearest_by_rounds(both: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """nearest_targets with all sources advancing together: each round relaxes the edges at the nodes that improved.

    A source stops where no open node is nearer than its n-th target, and keeps nothing beyond that.
    """
    state = materialise(starts.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.array("source").alias("path"), "goal", F.lit(True).alias("new")), "paths")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("dist", "path"))
    while True:
        limit = state.where("goal").withColumn("k", rank).where(F.col("k") == n).select("source", F.col("dist").alias("limit"))
        within = state.join(limit, "source", "left").where("limit is null or dist <= limit")
        open_ = within.where("new and (limit is null or dist < limit)").withColumnRenamed("goal", "_goal")
        step = open_.join(both, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.concat("path", F.array("v")).alias("path"), "goal", F.lit(1).alias("fresh"), "limit")
        step = step.where("limit is null or dist <= limit").drop("limit")
        merged = within.select("source", "node", "dist", "path", "goal", F.lit(0).alias("fresh")).unionByName(step).groupBy("source", "node").agg(F.min(F.struct("dist", "path", "fresh")).alias("b"), F.bool_or("goal").alias("goal"))
        after = materialise(merged.select("source", "node", "b.dist", "b.path", "goal", (F.col("b.fresh") == 1).alias("new")), "paths")
        release(state)
        state = after
        if state.where("new").isEmpty():
            break
    return state.where("goal").withColumn("k", rank).where(F.col("k") <= n).select("source", F.col("node").alias("target"), "dist", "path")


def path_steps(paths: DataFrame) -> DataFrame:
    """u, v, source, target: one row for each edge of each path, the lesser node first."""
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.least(F.col("path")[i - 1], F.col("path")[i]).alias("u"), F.greatest(F.col("path")[i - 1], F.col("path")[i]).alias("v")))
    return paths.where(F.size("path") > 1).select("source", "target", F.explode(step).alias("e")).select("e.u", "e.v", "source", "target")


def edge_usage(paths: DataFrame) -> DataFrame:
    """u, v, path_count, terminals: how many paths pass each edge, and the distinct ends of these paths."""
    steps = path_steps(paths)
    ends = steps.select("u", "v", F.explode(F.array("source", "target")).alias("t")).groupBy("u", "v").agg(F.count_distinct("t").alias("terminals"))
    return steps.groupBy("u", "v").agg(F.count("*").alias("path_count")).join(ends, ["u", "v"])


def passes(edges: DataFrame, blocked: DataFrame, substations: DataFrame, clusters: DataFrame, near: tuple[int, int, int, int, int] = (2, 25, 2, 15, 2)) -> DataFrame:
    """pass, source, target, dist, path of the three passes of shortest paths.

    1: from every cluster to its nearest substations and to its nearest clusters, on all edges; 2: the same, with other
    numbers, on the edges that aren't blocked (u, v); 3: on these from every minor substation to its nearest major ones.
    substations: node, major; clusters: node. `near` gives the numbers, in this order.
    """
    ends = lambda df, name: df.select(F.col("node").alias(name)).distinct()
    low, high = F.least("u", "v"), F.greatest("u", "v")
    shut = blocked.select(low.alias("_u"), high.alias("_v")).distinct()
    open_ = materialise(edges.join(shut, (low == F.col("_u")) & (high == F.col("_v")), "left_anti"), "passes-open")
    both = lambda a, b: (ends(clusters, "source"), [(ends(substations, "target"), a), (ends(clusters, "target"), b + 1)])
    minor = (ends(substations.where("not major"), "source"), [(ends(substations.where("major"), "target"), near[4])])
    found = [*nearest_of_each(edges, [both(*near[:2])]), *nearest_of_each(open_, [both(*near[2:4]), minor])]
    first, second, third = (x.where("source <> target").withColumn("pass", F.lit(i)) for i, x in enumerate(found, 1))
    return first.unionByName(second).unionByName(third).select("pass", "source", "target", "dist", "path")


def path_stats(edges: DataFrame, paths: DataFrame, classes: DataFrame) -> DataFrame:
    """edges (u, v, ...) with twelve columns of path use, and whether any path uses them.

    For each pass N: pN_count paths, pN_terminals distinct ends of them, pN_entropy (bits) and pN_mode of the ends' classes,
    where an end without a class is `unknown`; 0 and null without any path. classes: node, cls, one row per node.

    Ends take their classes along the path, and an edge's paths and its distinct ends are counted from one table of all passes.
    """
    named = paths
    for end in ("source", "target"):
        of = classes.select(F.col("node").alias(f"_{end}"), F.col("cls").alias(f"{end}_cls"))
        named = named.join(of, F.col(end) == F.col(f"_{end}"), "left").withColumn(f"{end}_cls", F.coalesce(f"{end}_cls", F.lit("unknown")))
    at = F.col("path")
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.least(at[i - 1], at[i]).alias("u"), F.greatest(at[i - 1], at[i]).alias("v")))
    both = F.array(*[F.struct(F.col(end).alias("t"), F.col(f"{end}_cls").alias("cls"), F.lit(n).alias("n")) for end, n in (("source", 1), ("target", 0))])
    steps = named.where(F.size("path") > 1).select("pass", F.explode(step).alias("e"), both.alias("ends")).select("pass", "e.u", "e.v", F.explode("ends").alias("t")).select("pass", "u", "v", "t.*")
    ends = steps.groupBy("pass", "u", "v", "t", "cls").agg(F.sum("n").alias("n"))
    per = ends.groupBy("pass", "u", "v", "cls").agg(F.sum("n").alias("paths"), F.count("*").alias("n"))
    use = per.groupBy("pass", "u", "v").agg(F.sum("paths").alias("count"), F.sum("n").alias("terminals"), aggregate.entropy_of_counts("n").alias("entropy"), aggregate.mode_of_counts("cls", "n").alias("mode"))
    names = [f"p{n}_{c}" for n in (1, 2, 3) for c in ("count", "terminals", "entropy", "mode")]
    of_pass = lambda name: F.max(F.when(F.col("pass") == int(name[1]), F.col(name[3:]))).alias(name)
    wide = use.groupBy(F.col("u").alias("_u"), F.col("v").alias("_v")).agg(*[of_pass(x) for x in names])
    out = edges.withColumns({"_u": F.least("u", "v"), "_v": F.greatest("u", "v")}).join(wide, ["_u", "_v"], "left")
    out = out.na.fill(0, [f"p{n}_{c}" for n in (1, 2, 3) for c in ("count", "terminals")]).na.fill(0.0, [f"p{n}_entropy" for n in (1, 2, 3)])
    return out.drop("_u", "_v").withColumn("is_used_by_any_path", (F.col("p1_count") + F.col("p2_count") + F.col("p3_count") > 0).cast("int"))


def remove_blocked(edges: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """Drops the edges (id, x1 to y2) whose straight chord touches a zone's box."""
    lo, hi = g.clip_interval("l_x1", "l_y1", "l_x2", "l_y2", "r_minx", "r_miny", "r_maxx", "r_maxy")
    hits = sj.box_pairs(sj.boxed_segments(edges), zones, cell).where(lo <= hi)
    return sj.without_match(edges, "id", hits)


# ---------------------------------------------------------------- synthetic links


def spanning_links(points: DataFrame, group: str, most: float, neighbours: int = 4) -> DataFrame:
    """Per group: the edges of a minimum spanning tree and of the nearest neighbours, none longer than most.

    A group is what one polygon holds, a few points per 300 000 m2; Prim's algorithm runs on one group at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("id").reset_index(drop=True)
        xy = pdf[["x", "y"]].to_numpy(float)
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        links: set[tuple[int, int]] = set()
        if len(xy) > 1:
            best, from_, inside = d[0].copy(), np.zeros(len(xy), int), np.zeros(len(xy), bool)
            inside[0] = True
            for _ in range(len(xy) - 1):
                best[inside] = np.inf
                j = int(best.argmin())
                links.add((min(j, int(from_[j])), max(j, int(from_[j]))))
                inside[j] = True
                nearer = d[j] < best
                best[nearer], from_[nearer] = d[j][nearer], j
            for i in range(len(xy)):
                for j in np.argsort(d[i], kind="stable")[: min(neighbours, len(xy) - 1)]:
                    links.add((min(i, int(j)), max(i, int(j))))
        out = [(pdf[group][0], int(pdf["id"][a]), int(pdf["id"][b]), float(d[a, b])) for a, b in sorted(links) if d[a, b] <= most]
        return pd.DataFrame(out, columns=[group, "a_id", "b_id", "dist"])

    kind = points.schema[group].dataType.simpleString()
    return points.select(group, "id", "x", "y").groupBy(group).applyInPandas(run, f"{group} {kind}, a_id long, b_id long, dist double")


def seed_points(zones: DataFrame, per: float, least: float) -> DataFrame:
    """zone_id, id, x, y: max(1, area / per) places in each box of at least so large an area, drawn by hashes of zone and number."""
    size = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    n = F.greatest(F.lit(1), F.floor(size / F.lit(per))).cast("int")
    out = zones.where(size >= least).select(F.col("id").alias("zone_id"), "minx", "miny", "maxx", "maxy", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    draw = lambda salt: F.pmod(F.xxhash64("zone_id", "k", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.select("zone_id", (F.col("zone_id") * 1000 + F.col("k")).alias("id"), (F.col("minx") + draw(1) * (F.col("maxx") - F.col("minx"))).alias("x"), (F.col("miny") + draw(2) * (F.col("maxy") - F.col("miny"))).alias("y"))

