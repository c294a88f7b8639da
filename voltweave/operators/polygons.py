"""Polygon operators over the geometry struct (see sources.codecs), on the kernels of operators.shapes.

Pairs come from cell joins on the boxes; each Arrow function then works on one row, or on one group that shares a key or touches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.operators import shapes
from voltweave.operators import spatial_join as sj
from voltweave.operators.components import connected_components
from voltweave.session import materialise
from voltweave.sources.codecs import GEOMETRY


def polygons_of(g) -> list[shapes.Polygon]:
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in g["parts"]] if g is not None else []


def lines_of(g) -> list[shapes.Ring]:
    return [part[0] for part in polygons_of(g)] if g is not None else []


def geometry_of(rings: list[shapes.Ring]) -> dict:
    """A multipolygon of the rings, each closed."""
    return {"kind": "MultiPolygon", "parts": [[[{"x": x, "y": y} for x, y in [*r, r[0]]]] for r in rings]}


def boxed(df: DataFrame, geometry: str = "geom_") -> DataFrame:
    """df with minx, miny, maxx, maxy of its geometry."""
    points = F.flatten(F.flatten(F.col(geometry)["parts"]))
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return df.withColumns({"minx": of(F.array_min, "x"), "miny": of(F.array_min, "y"), "maxx": of(F.array_max, "x"), "maxy": of(F.array_max, "y")})


def area(geometry: Column) -> Column:
    """Area of what the geometry covers, overlaps of its parts once."""

    @F.pandas_udf("double")
    def f(g: pd.DataFrame) -> pd.Series:
        return pd.Series([shapes.area(shapes.combine(polygons_of({"parts": p}), [], "union")) if p is not None else None for p in g["parts"]], dtype="float64")

    return f(geometry)


def valid(geometry: Column) -> Column:
    """The same coverage as a set of trapezoids: no ring crosses itself or another."""

    @F.pandas_udf(GEOMETRY)
    def f(g: pd.DataFrame) -> pd.DataFrame:
        out = [geometry_of(shapes.combine(polygons_of({"parts": p}), [], "union")) for p in g["parts"]]
        return pd.DataFrame({"kind": [x["kind"] for x in out], "parts": [x["parts"] for x in out]})

    return f(geometry)


def simplified(geometry: Column, tolerance: float) -> Column:
    """Douglas-Peucker on every ring."""

    @F.pandas_udf(GEOMETRY)
    def f(g: pd.DataFrame) -> pd.DataFrame:
        parts = [[[[{"x": x, "y": y} for x, y in shapes.simplify(r, tolerance)] for r in poly] for poly in polygons_of({"parts": p})] for p in g["parts"]]
        return pd.DataFrame({"kind": g["kind"], "parts": parts})

    return f(geometry)


def inner_point(geometry: Column) -> Column:
    """A point inside the largest part."""

    @F.pandas_udf("struct<x:double,y:double>")
    def f(g: pd.DataFrame) -> pd.DataFrame:
        out = [shapes.inner_point(max(polygons_of({"parts": p}), key=lambda q: shapes.ring_area(q[0]))) for p in g["parts"]]
        return pd.DataFrame(out, columns=["x", "y"])

    return f(geometry)


def dissolve(df: DataFrame, key: str | None = None, geometry: str = "geom_") -> DataFrame:
    """One multipolygon per key, or per group of touching shapes: key or component, n, area, geom_.

    A whole layer is never gathered: without a key, shapes whose boxes touch form the groups, and their union has no more to it.
    """
    if key is None:
        named = materialise(boxed(df.withColumn("_id", F.monotonically_increasing_id()), geometry), "dissolve")
        pairs = sj.box_pairs(named.select("_id", *sj.BOX), named.select("_id", *sj.BOX), 500.0).where("l__id < r__id")
        named = named.join(connected_components(pairs, "l__id", "r__id"), F.col("_id") == F.col("node"), "left")
        df, key = named.withColumn("component", F.coalesce("component", "_id")), "component"
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = shapes.combine([p for g in pdf["g"] for p in polygons_of(g)], [], "union")
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)], "area": [shapes.area(rings)], "geom_": [geometry_of(rings)]})

    out = df.select(F.col(key).alias("k"), F.col(geometry).alias("g")).groupBy("k").applyInPandas(run, f"k {kind}, n long, area double, geom_ {GEOMETRY}")
    return out.withColumnRenamed("k", key)


def overlap_pairs(left: DataFrame, right: DataFrame, cell: float, op: str = "intersection") -> DataFrame:
    """Pairs whose boxes touch, with l_ and r_ columns and area: of the intersection, union or difference of the two."""

    @F.pandas_udf("double")
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series([shapes.area(shapes.combine(polygons_of({"parts": p}), polygons_of({"parts": q}), op)) for p, q in zip(a["parts"], b["parts"], strict=True)], dtype="float64")

    return sj.box_pairs(boxed(left), boxed(right), cell).withColumn("area", f(F.col("l_geom_"), F.col("r_geom_")))


def disc_overlaps(points: DataFrame, polygons: DataFrame, radius: float, cell: float) -> DataFrame:
    """id, area: polygon area within a radius of each point, summed over polygons without union; 0 where there is none."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series, g: pd.DataFrame) -> pd.Series:
        return pd.Series([shapes.area(shapes.combine([shapes.disc(a, b, radius)], polygons_of({"parts": p}), "intersection")) for a, b, p in zip(x, y, g["parts"], strict=True)], dtype="float64")

    pairs = sj.box_pairs(sj.boxed_points(points), boxed(polygons), cell, radius).withColumn("area", f(F.col("l_x"), F.col("l_y"), F.col("r_geom_")))
    total = pairs.groupBy(F.col("l_id").alias("id")).agg(F.sum("area").alias("area"))
    return points.select("id").join(total, "id", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def clipped_lines(lines: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Line by polygon overlay: l_ and r_ columns, start and end along the line, for every stretch inside."""

    @F.pandas_udf("array<struct<start:double,end:double>>")
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for p, q in zip(a["parts"], b["parts"], strict=True):
            done, found = 0.0, []
            for line in lines_of({"parts": p}):
                for poly in polygons_of({"parts": q}):
                    found += [{"start": done + s, "end": done + e} for s, e in shapes.line_inside(line, poly)]
                done += sum(math.dist(u, v) for u, v in zip(line, line[1:], strict=False))
            out.append(found)
        return pd.Series(out, dtype=object)

    pairs = sj.box_pairs(boxed(lines), boxed(polygons), cell).withColumn("s", F.explode(f(F.col("l_geom_"), F.col("r_geom_"))))
    return pairs.select("*", "s.start", "s.end").drop("s")


def within_mask(layer: DataFrame, mask: DataFrame, cell: float) -> DataFrame:
    """Points (id, x, y) inside any polygon of a mask."""

    @F.pandas_udf("boolean")
    def f(x: pd.Series, y: pd.Series, g: pd.DataFrame) -> pd.Series:
        return pd.Series([any(shapes.contains(q, a, b) for q in polygons_of({"parts": p})) for a, b, p in zip(x, y, g["parts"], strict=True)], dtype=bool)

    hits = sj.box_pairs(sj.boxed_points(layer), boxed(mask), cell).where(f(F.col("l_x"), F.col("l_y"), F.col("r_geom_")))
    return sj.with_match(layer, "id", hits)
