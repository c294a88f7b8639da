"""What lies around points: order statistics of the things within a radius, sums over the boxes that hold a point.

Things and points meet in blocks, whose tasks put out one row per point; pairs are never written. The points of a small cell share what
is within the radius of all of them; only the things on the rim are tested point by point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from voltweave.operators import spatial_join as sj

#: Pairs of a point and a thing on its rim that are tested at once.
TESTED = 200_000
#: Points of a cell, on average.
SHARED = 60
STATS = ("n", "median", "std", "total")


def surroundings(units: DataFrame, things: DataFrame, radius: float, size: str, names: tuple[str, str, str, str], boxes: DataFrame | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """units (x, y, ...) with the number of things (x, y) within the radius, and of their sizes the median, the deviation and the sum;
    with boxes also the sums of some of their columns over the boxes that hold the unit, zero for none.

    Things without a size only count. Without things the median, deviation and sum are null, as is the deviation of one.
    """
    block = F.lit(6.0 * radius)
    number = lambda c: F.col(c).cast("double")
    at = lambda c, d=0.0: F.floor((F.col(c) + F.lit(d)) / block)
    values = [f"_v{i}" for i in range(4 + len(sums))]

    def dealt(df: DataFrame, kind, box: tuple[str, ...], columns: list, margin: float) -> DataFrame:
        rows = df.select(kind.cast("int").alias("_kind"), *[number(c).alias(f"_c{i}") for i, c in enumerate(box)], *[c.cast("double").alias(v) for c, v in zip(columns, values, strict=True)])
        for i in range(4):
            rows = rows.where(F.col(f"_c{i}").isNotNull() & ~F.isnan(f"_c{i}"))
        cells = rows.withColumn("_i", F.explode(F.sequence(at("_c0", -margin), at("_c2", margin)))).withColumn("_j", F.explode(F.sequence(at("_c1", -margin), at("_c3", margin))))
        return cells.select("_i", "_j", "_kind", *values)

    none = F.lit(None)
    right = dealt(things, F.when(F.col(size).isNull(), 1).otherwise(0), ("x", "y", "x", "y"), [F.col("x"), F.col("y"), F.col(size), none, *[none] * len(sums)], radius * (1 + 1e-6))
    if boxes is not None:
        right = right.unionByName(dealt(boxes, F.lit(2), sj.BOX, [*[F.col(c) for c in sj.BOX], *[F.coalesce(F.col(c), F.lit(0.0)) for c in sums]], 0.0))
    added = [*names, *sums]
    schema = StructType([*units.schema.fields, *[StructField(c, LongType() if c == names[0] else DoubleType()) for c in added]])
    keep, many = units.columns, len(sums)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        px, py = (left.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y"))
        kind, rows = right.column("_kind").to_numpy(), [right.column(v).to_numpy() for v in values]
        n, stats, held = around(px, py, *(r[kind == 0] for r in rows[:3]), radius, [r[kind == 2] for r in rows], many)
        if (kind == 1).any():
            known = np.isfinite(px) & np.isfinite(py)
            n[known] += sj._counts_within(px[known], py[known], *(r[kind == 1] for r in rows[:2]), radius, radius / 40)
        out = left.select(keep)
        for c, v in zip(added, [n, *stats, *held], strict=True):
            out = out.append_column(c, pa.array(v, from_pandas=c in names))
        return out

    own = units.withColumns({"_i": at("x"), "_j": at("y")})
    return own.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, schema)


def _limit(radius: float) -> float:
    """The largest square of a distance that is at most the radius."""
    t = radius * radius
    while np.sqrt(t) > radius:
        t = np.nextafter(t, 0.0)
    while np.sqrt(np.nextafter(t, np.inf)) <= radius:
        t = np.nextafter(t, np.inf)
    return float(t)


def around(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, radius: float, boxes: list[np.ndarray], sums: int = 0) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each point the number of things (x, y, v) within the radius; median, deviation and sum of v; sums over the boxes that hold it."""
    n, stats, held = np.zeros(len(px), np.int64), [np.full(len(px), np.nan) for _ in range(3)], [np.zeros(len(px)) for _ in range(sums)]
    known = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    if not len(known) or not (len(x) or len(boxes[0])):
        return n, stats, held
    order = np.argsort(v, kind="stable")
    x, y, v = x[order], y[order], v[order]
    finite = np.isfinite(v)
    middle, all_finite = float(v[finite].mean()) if finite.any() else 0.0, bool(finite.all())
    with np.errstate(invalid="ignore"):
        dev = np.where(finite, v - middle, 0.0)
    limit = _limit(radius)
    px0, py0 = px[known].min(), py[known].min()
    spread = max(px[known].max() - px0, py[known].max() - py0)
    slack = radius * 1e-9 + 1e-12 * max(np.abs(px[known]).max(), np.abs(py[known]).max())
    cell = min(max(np.sqrt(SHARED / len(known)) * spread, radius / 16), radius)
    col, row = ((a[known] - o) / cell for a, o in ((px, px0), (py, py0)))
    col, row = np.floor(col).astype(np.int64), np.floor(row).astype(np.int64)
    by = np.lexsort((col, row))
    known, col, row = known[by], col[by], row[by]
    begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])))
    rows = np.flatnonzero(np.append(True, row[begin][1:] != row[begin][:-1]))  # the first cell of each row of cells
    ends, last = np.append(begin[1:], len(known)), np.append(rows[1:], len(begin))
    for r, s in zip(rows, last, strict=True):
        mine = py[known[begin[r] : ends[s - 1]]]
        strip = np.flatnonzero((y >= mine.min() - radius - slack) & (y <= mine.max() + radius + slack))
        sx, sy = x[strip], y[strip]
        wide = np.flatnonzero((boxes[1] <= mine.max()) & (boxes[3] >= mine.min()))
        near = [b[wide] for b in boxes]
        for k in range(r, s):
            who = known[begin[k] : ends[k]]
            ux, uy = px[who], py[who]
            x0, x1, y0, y1 = ux.min(), ux.max(), uy.min(), uy.max()
            if len(strip):
                at = np.flatnonzero((sx >= x0 - radius - slack) & (sx <= x1 + radius + slack))
                dx, dy = sx[at] - (x0 + x1) / 2, sy[at] - (y0 + y1) / 2
                d = np.sqrt(dx * dx + dy * dy)
                half = np.hypot(x1 - x0, y1 - y0) / 2
                inner = d <= radius - half - slack
                rim = np.flatnonzero((d <= radius + half + slack) & ~inner)
                before, at_rim, at_inner = np.cumsum(inner)[rim], strip[at[rim]], strip[at[inner]]
                step = max(1, TESTED // max(1, len(rim)))
                for p in range(0, len(who) if len(rim) or len(at_inner) else 0, step):
                    q = slice(p, p + step)
                    found = _ranked(ux[q], uy[q], x[at_rim], y[at_rim], limit, before, v[at_inner], v[at_rim], dev[at_inner], dev[at_rim], middle, all_finite)
                    n[who[q]] = found[0]
                    for out, f in zip(stats, found[1:], strict=True):
                        out[who[q]] = f
            if len(wide) and sums:
                at = np.flatnonzero((near[0] <= x1) & (near[2] >= x0))
                step = max(1, TESTED // max(1, len(at)))
                for p in range(0, len(who), step):
                    a, b = ux[p : p + step, None], uy[p : p + step, None]
                    inside = (a >= near[0][at]) & (a <= near[2][at]) & (b >= near[1][at]) & (b <= near[3][at])
                    for out, value in zip(held, near[4:], strict=True):
                        out[who[p : p + step]] = np.where(inside, value[at], 0.0).sum(axis=1)
    return n, stats, held


def _ranked(px, py, x, y, limit, before, inner_v, rim_v, inner_dev, rim_dev, middle, all_finite) -> tuple[np.ndarray, ...]:
    """n, median, deviation, sum for points that share the inner things; both kinds are in the order of v, and `before` tells how many
    inner ones precede each on the rim. The k-th of both lists together is found by a binary search, as their count grows along the rim."""
    d, e = np.subtract.outer(px, x), np.subtract.outer(py, y)
    d *= d
    e *= e
    d += e
    hit = d <= limit
    units, rims = np.arange(len(px)), len(x)
    base = units * (rims + len(inner_v) + 1)  # sets the units' counts apart, so that one search finds all places
    kind = np.int32 if len(px) * (rims + len(inner_v) + 1) < 2**31 else np.int64
    upto = np.cumsum(hit, axis=1, dtype=kind)
    n = len(inner_v) + (upto[:, -1] if rims else np.zeros(len(px), kind)).astype(np.int64)
    upto += before.astype(kind)
    upto += base.astype(kind)[:, None]
    picked = []
    for k in ((n - 1) // 2, n // 2):
        if not rims:
            picked.append(inner_v[np.maximum(k, 0)])
            continue
        low = np.searchsorted(upto.reshape(-1), (base + k).astype(kind), side="right") - units * rims
        past = np.maximum(low, 1) - 1
        i = k - np.where(low > 0, upto[units, past] - before[past] - base, 0)  # the place among the inner ones
        at = np.minimum(low, rims - 1)
        own = i < np.where(low < rims, before[at], len(inner_v))
        picked.append(np.where(own, inner_v[np.clip(i, 0, len(inner_v) - 1)], rim_v[at]) if len(inner_v) else rim_v[at])
    with np.errstate(invalid="ignore"):
        median = np.where(picked[0] == picked[1], picked[0], 0.5 * picked[0] + 0.5 * picked[1])
        weight = hit.astype(np.float64)
        first, second = (weight @ np.column_stack([rim_dev, rim_dev * rim_dev])).T + np.array([[inner_dev.sum()], [(inner_dev * inner_dev).sum()]])
        some = np.maximum(n, 1)
        square = second - first * first / some
        close = np.flatnonzero((n > 1) & (square <= 1e-6 * second))  # so much cancels out that it is summed around the point's own mean
        step = max(1, TESTED // (rims + len(inner_dev) + 1))
        for p in range(0, len(close), step):
            c = close[p : p + step]
            mean = (first[c] / n[c])[:, None]
            square[c] = np.where(hit[c], (rim_dev - mean) ** 2, 0.0).sum(axis=1) + ((inner_dev - mean) ** 2).sum(axis=1)
        std = np.where(n > 1, np.sqrt(np.maximum(square, 0.0) / np.maximum(n - 1, 1)), np.nan)
        total = np.where(n > 0, middle * n + first, np.nan)
        if not all_finite:
            odd = np.where(hit & ~np.isfinite(rim_v), rim_v, 0.0).sum(axis=1) + inner_v[~np.isfinite(inner_v)].sum()
            total, std = np.where(np.isfinite(odd), total, odd), np.where(np.isfinite(odd), std, np.nan)
        return n, np.where(n > 0, median, np.nan), std, total
