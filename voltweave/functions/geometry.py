"""Planar geometry as column expressions.

A line or ring is ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>; boxes are four columns minx, miny, maxx, maxy. All measures stay in the
JVM: two-vertex segments as plain arithmetic, longer lines with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def segment_length(p: str = "") -> Column:
    return distance(f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2")


def foot(px: Column | str, py: Column | str, x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    """Share of the segment at which a point's nearest place lies, 0 for a segment without length."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(square != 0, square))))


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    t = foot(px, py, x1, y1, x2, y2)
    return distance(px, py, col(x1) + t * (col(x2) - col(x1)), col(y1) + t * (col(y2) - col(y1)))


def segments_cross(a: str, b: str) -> Column:
    """Whether two segments, given by column prefixes, meet in one point (parallel ones don't)."""
    d, t, u = _crossing(a, b)
    return (d != 0) & t.between(0, 1) & u.between(0, 1)


def crossing_share(a: str, b: str) -> Column:
    """Share of segment a at which it crosses the line of b; null if parallel."""
    return _crossing(a, b)[1]


def _crossing(a: str, b: str) -> tuple[Column, Column, Column]:
    ax, ay, bx, by = (F.col(f"{p}{c}") for p in (a, b) for c in ("x1", "y1"))
    rx, ry = F.col(f"{a}x2") - ax, F.col(f"{a}y2") - ay
    sx, sy = F.col(f"{b}x2") - bx, F.col(f"{b}y2") - by
    d = rx * sy - ry * sx
    safe = F.when(d != 0, d)
    return d, ((bx - ax) * sy - (by - ay) * sx) / safe, ((bx - ax) * ry - (by - ay) * rx) / safe


def segment_distance(a: str, b: str) -> Column:
    """Least distance of two segments given by column prefixes."""

    def end(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        # the share is bound to a variable: written out at each use, the four distances make an expression too large to compile
        return F.transform(F.array(foot(px, py, x1, y1, x2, y2)), lambda t: distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1)))[0]

    ends = [end(*[F.col(c) for c in (f"{p}x{i}", f"{p}y{i}", f"{q}x1", f"{q}y1", f"{q}x2", f"{q}y2")]) for p, q in ((a, b), (b, a)) for i in (1, 2)]
    return F.when(F.coalesce(segments_cross(a, b), F.lit(False)), F.lit(0.0)).otherwise(F.least(*ends))


def segments_near(a: str, b: str, reach: float) -> Column:
    """Whether two segments are within reach of each other: by products only, which are exact for whole coordinates.

    They are if they cross, each with its ends on both sides of the other, or if an end of one is near the other: near one of
    its ends, or near its line with the foot inside.
    """
    square = F.lit(float(reach * reach))
    near, apart = [], []
    for p, q in ((a, b), (b, a)):
        dx, dy, sides = F.col(f"{q}x2") - F.col(f"{q}x1"), F.col(f"{q}y2") - F.col(f"{q}y1"), []
        for i in (1, 2):
            ex, ey = F.col(f"{p}x{i}") - F.col(f"{q}x1"), F.col(f"{p}y{i}") - F.col(f"{q}y1")
            dot, cross, long = ex * dx + ey * dy, ex * dy - ey * dx, dx * dx + dy * dy
            inside = (dot > 0) & (dot < long) & (cross * cross <= square * long)
            near.append(inside)
            sides.append(cross)
        apart.append(sides[0] * sides[1] < 0)
    for i in (1, 2):
        for j in (1, 2):
            ex, ey = F.col(f"{a}x{i}") - F.col(f"{b}x{j}"), F.col(f"{a}y{i}") - F.col(f"{b}y{j}")
            near.append(ex * ex + ey * ey <= square)
    out = apart[0] & apart[1]
    for x in near:
        out = out | x
    return out


def clip_interval(x1, y1, x2, y2, minx, miny, maxx, maxy) -> tuple[Column, Column]:
    """Liang-Barsky: first and last share of a segment inside a box; the first exceeds the last if they don't meet."""
    x1, y1, x2, y2, minx, miny, maxx, maxy = map(col, (x1, y1, x2, y2, minx, miny, maxx, maxy))
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for a, d, lo, hi in ((x1, x2 - x1, minx, maxx), (y1, y2 - y1, miny, maxy)):
        safe = F.when(d != 0, d)
        outside = (d == 0) & ((a < lo) | (a > hi))
        near, far = (lo - a) / safe, (hi - a) / safe
        low.append(F.when(outside, F.lit(2.0)).otherwise(F.coalesce(F.least(near, far), F.lit(0.0))))
        high.append(F.when(outside, F.lit(-1.0)).otherwise(F.coalesce(F.greatest(near, far), F.lit(1.0))))
    return F.greatest(*low), F.least(*high)


def capsule_interval(x1, y1, x2, y2, px, py, radius) -> tuple[Column, Column]:
    """First and last share of a segment within a radius of a point; both null if nowhere."""
    x1, y1, x2, y2, px, py = map(col, (x1, y1, x2, y2, px, py))
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - px, y1 - py
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
    disc = b * b - a * c
    root, safe = F.sqrt(F.when(disc >= 0, disc)), F.when(a != 0, a)
    lo, hi = F.greatest(F.lit(0.0), (-b - root) / safe), F.least(F.lit(1.0), (-b + root) / safe)
    met = F.when(a == 0, c <= 0).otherwise(disc >= 0) & (lo <= hi)  # greatest and least skip nulls, so a miss must be told apart
    return F.when(met, lo), F.when(met, hi)


def overlap_area(a: str = "l_", b: str = "r_") -> Column:
    """Area shared by two boxes given by column prefixes."""
    w = F.least(f"{a}maxx", f"{b}maxx") - F.greatest(f"{a}minx", f"{b}minx")
    h = F.least(f"{a}maxy", f"{b}maxy") - F.greatest(f"{a}miny", f"{b}miny")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


# ---------------------------------------------------------------- lines and rings


def _steps(line: Column | str) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(col(line)) - 1))


def line_length(line: Column | str) -> Column:
    line = col(line)
    step = lambda i: F.sqrt((line[i]["x"] - line[i - 1]["x"]) ** 2 + (line[i]["y"] - line[i - 1]["y"]) ** 2)
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.aggregate(_steps(line), F.lit(0.0), lambda acc, i: acc + F.coalesce(step(i), F.lit(0.0))))


def ring_area(ring: Column | str) -> Column:
    """Area of a closed ring, by the shoelace formula."""
    ring = col(ring)
    part = lambda i: ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"]
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(F.abs(F.aggregate(_steps(ring), F.lit(0.0), lambda acc, i: acc + part(i))) / 2)


def ring_centroid(ring: Column | str) -> Column:
    """Area centroid of a closed ring; the mean of the vertices if it has no area."""
    ring = col(ring)
    cross = lambda i: ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"]
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "x", "y")])
    total = F.aggregate(_steps(ring), zero, lambda s, i: F.struct((s["a"] + cross(i)).alias("a"), (s["x"] + (ring[i - 1]["x"] + ring[i]["x"]) * cross(i)).alias("x"), (s["y"] + (ring[i - 1]["y"] + ring[i]["y"]) * cross(i)).alias("y")))
    safe = F.when(total["a"] != 0, total["a"] * 3)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(ring)
    return F.struct(F.coalesce(total["x"] / safe, mean("x")).alias("x"), F.coalesce(total["y"] / safe, mean("y")).alias("y"))


def line_centroid(line: Column | str) -> Column:
    """Length-weighted mean of the segments' midpoints; the first vertex if the line has no length."""
    line = col(line)
    size = lambda i: F.sqrt((line[i]["x"] - line[i - 1]["x"]) ** 2 + (line[i]["y"] - line[i - 1]["y"]) ** 2)
    mid = lambda c: F.aggregate(_steps(line), F.lit(0.0), lambda acc, i: acc + F.coalesce(size(i) * (line[i][c] + line[i - 1][c]) / 2, F.lit(0.0)))
    total = line_length(line)
    safe = F.when(total > 0, total)
    return F.struct(F.coalesce(mid("x") / safe, line[0]["x"]).alias("x"), F.coalesce(mid("y") / safe, line[0]["y"]).alias("y"))


def curvature(line: Column | str) -> Column:
    """Sum of the turning angles over the length; 0 with fewer than three vertices. Segments without length are left out."""
    kept = F.aggregate(
        F.slice(col(line), F.lit(2), F.greatest(F.lit(1), F.size(col(line)))),
        F.slice(col(line), 1, 1),
        lambda acc, p: F.when((F.element_at(acc, -1)["x"] != p["x"]) | (F.element_at(acc, -1)["y"] != p["y"]), F.concat(acc, F.array(p))).otherwise(acc),
    )

    def turn(i: Column) -> Column:
        ax, ay = kept[i]["x"] - kept[i - 1]["x"], kept[i]["y"] - kept[i - 1]["y"]
        bx, by = kept[i + 1]["x"] - kept[i]["x"], kept[i + 1]["y"] - kept[i]["y"]
        cosine = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(kept) - 2)), F.lit(0.0), lambda acc, i: acc + F.coalesce(turn(i), F.lit(0.0)))
    length = line_length(kept)
    return F.when((F.size(kept) < 3) | (length == 0), F.lit(0.0)).otherwise(total / F.when(length > 0, length))


def point_in_ring(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Even-odd test of a point against a closed ring."""
    x, y, ring = col(x), col(y), col(ring)

    def crosses(i: Column) -> Column:
        ax, ay, bx, by = ring[i - 1]["x"], ring[i - 1]["y"], ring[i]["x"], ring[i]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    return F.aggregate(_steps(ring), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))


def envelope(line: Column | str) -> list[Column]:
    """minx, miny, maxx, maxy of an array of points."""
    line = col(line)
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]


def stations(length: Column, spacing: float) -> Column:
    """Distances along a line at which to sample it: every spacing, the start included."""
    return F.transform(F.sequence(F.lit(0), F.floor(length / F.lit(spacing)).cast("int")), lambda i: i * F.lit(float(spacing)))


def interpolate(x1, y1, x2, y2, t: Column) -> Column:
    return point(col(x1) + t * (col(x2) - col(x1)), col(y1) + t * (col(y2) - col(y1)))
