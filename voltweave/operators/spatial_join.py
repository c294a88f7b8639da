"""Spatial joins as equi-joins on grid cells.

A predicate over distances or boxes alone would plan as a nested loop over all pairs. Here both sides are keyed by the cells that
their boxes touch, joined on the cell, and filtered by the exact predicate; a pair that shares several cells is emitted only in the
cell of its boxes' common lower corner, so no distinct is needed. Dense cells are ordinary skewed keys, which Spark's adaptive
execution splits. Sides are never broadcast by force: the optimizer does it where its size estimates allow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.functions.geometry import distance, point_segment_distance
from voltweave.session import materialise

BOX = ("minx", "miny", "maxx", "maxy")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def boxed_points(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"minx": F.col(x), "miny": F.col(y), "maxx": F.col(x), "maxy": F.col(y)})


def boxed_segments(df: DataFrame) -> DataFrame:
    return df.withColumns({"minx": F.least("x1", "x2"), "miny": F.least("y1", "y2"), "maxx": F.greatest("x1", "x2"), "maxy": F.greatest("y1", "y2")})


def _cells(df: DataFrame, p: str, cell: float, margin: float) -> DataFrame:
    at = lambda c, d: F.floor((F.col(p + c) + F.lit(d)) / F.lit(float(cell)))
    df = df.withColumn("_i", F.explode(F.sequence(at("minx", -margin), at("maxx", margin))))
    return df.withColumn("_j", F.explode(F.sequence(at("miny", -margin), at("maxy", margin))))


def box_pairs(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """All pairs whose boxes, the left one widened by margin, touch; columns get the prefixes l_ and r_.

    Both sides need minx, miny, maxx, maxy. Choose cells of about the size of the larger boxes plus the margin.
    """
    a, b = _cells(prefixed(left, "l_"), "l_", cell, margin), _cells(prefixed(right, "r_"), "r_", cell, 0.0)
    m = F.lit(float(margin))
    touch = (F.col("l_minx") - m <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx") + m) & (F.col("l_miny") - m <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy") + m)
    corner = lambda c: F.floor(F.greatest(F.col("l_" + c) - m, F.col("r_" + c)) / F.lit(float(cell)))
    joined = a.join(b, ["_i", "_j"]).where(touch & (F.col("_i") == corner("minx")) & (F.col("_j") == corner("miny")))
    return joined.drop("_i", "_j")


def fitting_cell(boxes: DataFrame, least: float) -> float:
    """A cell for joins of points with boxes: as wide as these are on average, so that each lies in about four cells."""
    size = boxes.select(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    return max(float(least), float(size or 0.0))


def within_distance(left: DataFrame, right: DataFrame, radius: float, d: Column, cell: float | None = None) -> DataFrame:
    """Pairs at most radius apart by the distance column d (over l_ and r_ columns), with that distance."""
    return box_pairs(left, right, cell or radius, radius).withColumn("dist", d).where(F.col("dist") <= F.lit(float(radius)))


def count_matches(left: DataFrame, key: str, pairs: DataFrame, name: str = "n") -> DataFrame:
    """left with the number of its pairs, 0 where there is none."""
    n = pairs.groupBy(F.col("l_" + key).alias(key)).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


#: Right points that one task of a radius count holds; a block with more is counted in several tasks, and the counts add up.
BLOCK_ROWS = 2_000_000


def radius_count(left: DataFrame, right: DataFrame, radius: float, key: str = "id", name: str = "n", parts: int = 40) -> DataFrame:
    """left points with the number of right points at most radius away, 0 where there is none.

    Points meet in blocks five radii wide, to which the right points within a radius of them are copied. In a block, the cells of
    radius / parts that lie wholly inside the circle give their counts by running totals, a row at a time; only the points of the
    cells on its rim are tested one by one.
    """
    size = F.lit(5.0 * radius)
    known = lambda df: df.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = lambda c, d=0.0: F.floor((F.col(c) + F.lit(d)) / size)
    margin = radius * (1 + 1e-6)
    near = known(right).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = near.withColumn("_i", F.explode(F.sequence(at("x", -margin), at("x", margin)))).withColumn("_j", F.explode(F.sequence(at("y", -margin), at("y", margin))))
    chunks = materialise(near.groupBy("_i", "_j").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_chunks")), "radius-blocks")
    near = near.join(chunks, ["_i", "_j"]).withColumn("_chunk", F.pmod(F.xxhash64("x", "y"), F.col("_chunks")).cast("int")).drop("_chunks")
    own = known(left).select(F.col(key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = own.withColumns({"_i": at("x"), "_j": at("y")}).join(chunks, ["_i", "_j"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_key": a["_key"][:0], "_c": np.zeros(0, int)})
        found = _counts_within(a["x"].to_numpy(), a["y"].to_numpy(), b["x"].to_numpy(), b["y"].to_numpy(), radius, radius / parts)
        return pd.DataFrame({"_key": a["_key"], "_c": found})

    kind = left.schema[key].dataType.simpleString()
    blocks = ["_i", "_j", "_chunk"]
    counts = own.groupBy(*blocks).cogroup(near.groupBy(*blocks)).applyInPandas(count, f"_key {kind}, _c long")
    total = counts.groupBy("_key").agg(F.sum("_c").alias("_c")).hint("merge")  # as many rows as left has: never broadcast
    return left.join(total, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_c", F.lit(0)).cast("long")).drop("_key", "_c")


def _counts_within(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, cell: float, most: int = 2_000_000) -> np.ndarray:
    """For each point p the number of points (x, y) at most radius away; at most so many tests are held at once."""
    out = np.zeros(len(px), np.int64)
    x0, y0 = x.min(), y.min()
    col, row = np.floor((x - x0) / cell).astype(np.int64), np.floor((y - y0) / cell).astype(np.int64)
    nx, ny = int(col.max()) + 1, int(row.max()) + 1
    order = np.argsort(row * nx + col, kind="stable")
    x, y = x[order], y[order]
    first = np.zeros(nx * ny + 1, np.int64)  # where each cell's points begin
    np.cumsum(np.bincount(row * nx + col, minlength=nx * ny), out=first[1:])
    slack = radius * 1e-9

    def tested(who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        some = end > begin
        who, begin, n = who[some], begin[some], (end - begin)[some]
        upto = np.cumsum(n)
        cuts = np.searchsorted(upto, np.arange(most, int(upto[-1]) if len(upto) else 0, most)).tolist()
        for p, q in zip([0, *cuts], [*cuts, len(who)], strict=True):
            if q > p:
                k = n[p:q]
                at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[p:q], k)
                of = np.repeat(who[p:q], k)
                dx, dy = px[of] - x[at], py[of] - y[at]
                np.add(out, np.bincount(of[np.sqrt(dx * dx + dy * dy) <= radius], minlength=len(out)), out=out)

    base = np.floor((py - y0) / cell).astype(np.int64)
    reach = int(np.ceil(radius / cell)) + 1
    for step in range(-reach, reach + 1):
        r = base + step
        low, high = r * cell + y0 - py, (r + 1) * cell + y0 - py
        near, far = np.maximum(np.maximum(low, -high) - slack, 0.0), np.maximum(-low, high) + slack
        who = np.flatnonzero((r >= 0) & (r < ny) & (near <= radius))
        if not len(who):
            continue
        start = r[who] * nx
        edge = lambda v: np.clip(np.floor(v / cell).astype(np.int64), 0, nx)
        wide, narrow = np.sqrt(radius * radius - near[who] ** 2) + slack, np.sqrt(np.maximum(radius * radius - far[who] ** 2, 0.0)) - slack
        mid = px[who] - x0
        a, d = edge(mid - wide), np.clip(np.floor((mid + wide) / cell).astype(np.int64) + 1, 0, nx)
        b, c = np.clip(np.ceil((mid - narrow) / cell).astype(np.int64), 0, nx), edge(mid + narrow)
        b = np.where((narrow > 0) & (c > b), np.maximum(b, a), d)  # without a cell inside, all are on the rim
        c = np.where(b < d, np.minimum(c, d), d)
        out[who] += first[start + c] - first[start + b]
        tested(who, first[start + a], first[start + b])
        tested(who, first[start + c], first[start + d])
    return out


def flag_matches(left: DataFrame, key: str, pairs: DataFrame, name: str = "hit") -> DataFrame:
    """left with 1 where it has a pair, else 0."""
    hit = pairs.select(F.col("l_" + key).alias(key)).distinct().withColumn(name, F.lit(1))
    return left.join(hit, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def with_match(left: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    return left.join(pairs.select(F.col("l_" + key).alias(key)).distinct(), key, "left_semi")


def without_match(left: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    return left.join(pairs.select(F.col("l_" + key).alias(key)), key, "left_anti")


def first_match(pairs: DataFrame, order: list[Column], key: str) -> DataFrame:
    """Of each left row's pairs the first in the order, which must be total."""
    w = Window.partitionBy("l_" + key).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def point_distance() -> Column:
    return distance("l_x", "l_y", "r_x", "r_y")


def point_line_distance() -> Column:
    return point_segment_distance("l_x", "l_y", "r_x1", "r_y1", "r_x2", "r_y2")


def k_nearest(left: DataFrame, right: DataFrame, k: int = 1, cell: float = 250.0, d: Callable[[], Column] = point_distance, key: str = "id", most: float | None = None) -> DataFrame:
    """The k nearest right rows of every left point: columns l_<key>, r_<key>, dist, rank; ties go to the smaller right key.

    A round looks into the cells that each right row reaches when widened by one cell's width, so every point finds all within that
    width in its own cell. A point is settled once it has k rows within that width; the others go on with cells twice as wide, so
    dense regions never see wide cells. The first cells are no wider than `cell` and hold about 2 k right rows, but are no narrower
    than these are on average. With `most`, rows farther than that don't count. Left rows without any right row have none.
    """
    bounds = [F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")]
    size = [F.count("*"), F.avg(F.col("maxx") - F.col("minx")), F.avg(F.col("maxy") - F.col("miny"))]
    both = [left.select(*bounds).first(), right.select(*bounds, *size).first()]
    if any(r[0] is None for r in both):
        return box_pairs(left, right, cell).select("l_" + key, "r_" + key, F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    span = max(max(r[1] for r in both) - min(r[0] for r in both), max(r[3] for r in both) - min(r[2] for r in both))
    want = float(most) if most is not None else float(span) * 1.5 + 1.0
    r = both[1]
    even = (2.0 * k * float(r[1] - r[0]) * float(r[3] - r[2]) / r[4]) ** 0.5
    width, todo, done = min(float(cell), max(even, float(r[5]), float(r[6]))) or float(cell), left, []
    at = lambda c: F.floor(F.col("l_" + c) / F.lit(width))
    while True:
        reach = min(width, want)
        own = prefixed(todo, "l_").withColumns({"_i": at("minx"), "_j": at("miny")})
        pairs = own.join(_cells(prefixed(right, "r_"), "r_", width, reach * (1 + 1e-6)), ["_i", "_j"]).withColumn("dist", d()).where(F.col("dist") <= reach)
        if k == 1:
            best = pairs.groupBy("l_" + key).agg(F.min(F.struct("dist", "r_" + key)).alias("b")).select("l_" + key, "b.r_" + key, "b.dist", F.lit(1).alias("rank"))
        else:
            w = Window.partitionBy("l_" + key).orderBy("dist", "r_" + key)
            best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("l_" + key, "r_" + key, "dist", "rank")
        if width >= want:
            done.append(best)
            break
        best = materialise(best, "nearest")
        full = best.where(F.col("rank") == k).select(F.col("l_" + key).alias(key)).hint("merge")  # as many rows as left has: never broadcast
        done.append(best if k == 1 else best.join(full.withColumnRenamed(key, "l_" + key), "l_" + key, "left_semi"))
        todo = materialise(todo.join(full, key, "left_anti"), "nearest-open")
        if todo.isEmpty():
            break
        width *= 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: Points of a layer that every task may hold at once; a larger layer stays distributed, with the same result.
HELD_POINTS = 2_000_000


class Places:
    """Points sorted into cells of about two, for searches in one task."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        x, y = np.unique(np.column_stack([x, y]), axis=0).T if len(x) else (x, y)
        self.n, self.x0, self.y0 = len(x), *((x.min(), y.min()) if len(x) else (0.0, 0.0))
        w, h = (x.max() - self.x0, y.max() - self.y0) if len(x) else (0.0, 0.0)
        self.cell = max(float(np.sqrt(2.0 * w * h / max(1, self.n))), float(max(w, h)) / (4.0 * max(1, self.n))) or 1.0
        col, row = self._cell(x, y)
        self.nx, self.ny = (int(col.max()) + 1, int(row.max()) + 1) if self.n else (1, 1)
        order = np.argsort(row * self.nx + col, kind="stable")
        self.x, self.y = np.ascontiguousarray(x[order]), np.ascontiguousarray(y[order])
        self.first = np.zeros(self.nx * self.ny + 1, np.int64)
        np.cumsum(np.bincount(row * self.nx + col, minlength=self.nx * self.ny), out=self.first[1:])

    def _cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor((x - self.x0) / self.cell).astype(np.int64), np.floor((y - self.y0) / self.cell).astype(np.int64)

    def nearest(self, px: np.ndarray, py: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        """Distance to the nearest place, NaN without any; at most so many tests are held at once (or those of one point).

        A point looks into a square of cells around its own, and into ever wider ones until what it found is nearer than all
        that lies outside.
        """
        best = np.full(len(px), np.inf)
        todo = np.flatnonzero(np.isfinite(px) & np.isfinite(py)) if self.n else np.zeros(0, np.int64)
        reach = 1
        while len(todo):
            x, y = px[todo], py[todo]
            col = np.clip(np.floor((x - self.x0) / self.cell), 0, self.nx - 1).astype(np.int64)
            row = np.clip(np.floor((y - self.y0) / self.cell), 0, self.ny - 1).astype(np.int64)
            a, b = np.maximum(col - reach, 0), np.minimum(col + reach, self.nx - 1) + 1
            for step in range(-min(reach, self.ny), min(reach, self.ny) + 1):
                r = row + step
                some = np.flatnonzero((r >= 0) & (r < self.ny))
                begin, end = self.first[r[some] * self.nx + a[some]], self.first[r[some] * self.nx + b[some]]
                some, begin, count = some[end > begin], begin[end > begin], (end - begin)[end > begin]
                upto = np.cumsum(count)
                cuts = np.unique(np.searchsorted(upto, np.arange(most, int(upto[-1]) if len(upto) else 0, most))).tolist()
                for p, q in zip([0, *cuts], [*cuts, len(some)], strict=True):
                    if q > p:
                        k = count[p:q]
                        start = np.cumsum(k) - k
                        at = np.arange(int(k.sum())) + np.repeat(begin[p:q] - start, k)
                        dx, dy = np.repeat(x[some[p:q]], k) - self.x[at], np.repeat(y[some[p:q]], k) - self.y[at]
                        who = todo[some[p:q]]
                        best[who] = np.minimum(best[who], np.minimum.reduceat(dx * dx + dy * dy, start))
            gap = np.full(len(todo), np.inf)
            for open_, side in (
                (col - reach > 0, x - (self.x0 + (col - reach) * self.cell)),
                (col + reach < self.nx - 1, self.x0 + (col + reach + 1) * self.cell - x),
                (row - reach > 0, y - (self.y0 + (row - reach) * self.cell)),
                (row + reach < self.ny - 1, self.y0 + (row + reach + 1) * self.cell - y),
            ):
                gap = np.where(open_, np.minimum(gap, side), gap)
            todo = todo[np.sqrt(best[todo]) > gap - 1e-6 * self.cell]
            if reach >= max(self.nx, self.ny):
                break
            reach *= 2
        return np.where(np.isfinite(best), np.sqrt(best), np.nan)


def held_places(layer: DataFrame) -> Places | None:
    """A layer's points (x, y) if they are few enough to be held, counted first."""
    known = layer.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if known.count() > HELD_POINTS:
        return None
    rows = known.toArrow()
    return Places(rows["x"].to_numpy(), rows["y"].to_numpy())


def distance_to_places(df: DataFrame, places: Places, name: str) -> DataFrame:
    """df with the distance of its points (x, y) to the nearest of the held places, null without any; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("double")
    def nearest(x: pd.Series, y: pd.Series) -> pd.Series:
        found = pd.Series(shared.value.nearest(x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)))
        return found.astype(object).where(found.notna(), None) if found.isna().any() else found

    return df.withColumn(name, nearest(F.col("x").cast("double"), F.col("y").cast("double")))
