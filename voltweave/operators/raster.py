"""Rasters as tables (row, col, v): zonal shares, disc and box neighbourhoods, terrain, regions, mosaics.

Row r, column c covers x in [x0 + c * res, x0 + (c + 1) * res) and y in [y0 - (r + 1) * res, y0 - r * res) where y counts
down from the top, or up from y0 where `up`. Neighbourhoods use prefix sums along rows, so that a disc of radius r costs 2r + 1
look-ups and a box four, however many pixels they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.operators import spatial_join as sj
from voltweave.operators.components import connected_components


def pixel_of(x: Column, y: Column, x0: float, y0: float, res: float, up: bool = True) -> tuple[Column, Column]:
    """row and col of a point."""
    row = F.floor((y - y0) / res) if up else F.floor((F.lit(y0) - y) / res)
    return row.cast("long"), F.floor((x - x0) / res).cast("long")


def sample(points: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float, name: str = "v") -> DataFrame:
    """points with the value of the pixel that they lie in, null outside."""
    row, col = pixel_of(F.col("x"), F.col("y"), x0, y0, res)
    return points.withColumn("_r", row).withColumn("_c", col).join(pixels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias(name)), ["_r", "_c"], "left").drop("_r", "_c")


def zonal_share(zones: DataFrame, pixels: DataFrame, classes: list[int], res: float) -> DataFrame:
    """id, pct: per cent of the pixels whose centre lies in the zone's box that have one of the classes. Zones: minx, ..., maxy."""
    first = lambda c: F.ceil(F.col(c) / res - 0.5).cast("long")
    last = lambda c: F.floor(F.col(c) / res - 0.5).cast("long")
    some = (first("miny") <= last("maxy")) & (first("minx") <= last("maxx"))
    cells = zones.where(some).select("id", F.explode(F.sequence(first("miny"), last("maxy"))).alias("row"), first("minx").alias("c0"), last("maxx").alias("c1"))
    cells = cells.select("id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    hit = cells.join(pixels, ["row", "col"])
    return hit.groupBy("id").agg((F.count_if(F.col("v").isin(*classes)) * 100.0 / F.count("v")).alias("pct"))


def dense(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every pixel of the extent, with null where the table has none."""
    spark = pixels.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    return grid.join(pixels, ["row", "col"], "left")


def disc_share(points: DataFrame, pixels: DataFrame, rows: int, cols: int, radius: int, classes: list[int]) -> DataFrame:
    """id, share: of the valid pixels at most radius from a point's pixel (row, col), the share with one of the classes; 0 without any."""
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    full = dense(pixels, rows, cols)
    sums = full.select("row", "col", F.sum(F.when(F.col("v").isin(*classes), 1).otherwise(0)).over(along).alias("hits"), F.count("v").over(along).alias("valid"))
    reach = F.floor(F.sqrt((F.lit(radius * radius) - F.col("dy") * F.col("dy")).cast("double"))).cast("long")
    runs = points.select("id", "row", "col", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dy")).withColumn("reach", reach)
    runs = runs.select("id", (F.col("row") + F.col("dy")).alias("row"), F.greatest(F.col("col") - F.col("reach"), F.lit(0)).alias("c0"), F.least(F.col("col") + F.col("reach"), F.lit(cols - 1)).alias("c1"))
    runs = runs.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("c0") <= F.col("c1")))
    ends = runs.select("id", "row", F.explode(F.array(F.struct(F.col("c1").alias("col"), F.lit(1).alias("sign")), F.struct((F.col("c0") - 1).alias("col"), F.lit(-1).alias("sign")))).alias("e")).select("id", "row", "e.col", "e.sign")
    found = ends.join(sums, ["row", "col"])
    per = found.groupBy("id").agg(F.sum(F.col("sign") * F.col("hits")).alias("hits"), F.sum(F.col("sign") * F.col("valid")).alias("valid"))
    return points.select("id").join(per, "id", "left").select("id", F.coalesce(F.col("hits") / F.nullif("valid", F.lit(0)), F.lit(0.0)).alias("share"))


def box_mean(pixels: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """row, col, mean: of each pixel of the table, the mean of the valid values in the box of side 2 radius + 1, cut at the border.

    A summed-area table from two running sums, looked up at the box's four corners.
    """
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    full = dense(pixels, rows, cols).select("row", "col", F.sum(F.coalesce("v", F.lit(0)).cast("double")).over(along).alias("s"), F.count("v").over(along).alias("n"))
    table = full.select("row", "col", F.sum("s").over(down).alias("s"), F.sum("n").over(down).alias("n"))
    r0, r1 = F.greatest(F.col("row") - radius, F.lit(0)) - 1, F.least(F.col("row") + radius, F.lit(rows - 1))
    c0, c1 = F.greatest(F.col("col") - radius, F.lit(0)) - 1, F.least(F.col("col") + radius, F.lit(cols - 1))
    corner = lambda r, c, sign: F.struct(r.alias("r"), c.alias("c"), F.lit(sign).alias("sign"))
    four = F.array(corner(r1, c1, 1), corner(r0, c1, -1), corner(r1, c0, -1), corner(r0, c0, 1))
    asked = pixels.where("v is not null").select("row", "col", F.explode(four).alias("k")).select("row", "col", "k.r", "k.c", "k.sign")
    found = asked.join(table.select(F.col("row").alias("r"), F.col("col").alias("c"), "s", "n"), ["r", "c"])
    return found.groupBy("row", "col").agg((F.sum(F.col("sign") * F.col("s")) / F.sum(F.col("sign") * F.col("n"))).alias("mean"))


def position_index(pixels: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """row, col, tpi: each value less its neighbourhood's mean."""
    return pixels.join(box_mean(pixels, rows, cols, radius), ["row", "col"]).select("row", "col", (F.col("v") - F.col("mean")).alias("tpi"))


def slope(pixels: DataFrame, rows: int, cols: int, res: float) -> DataFrame:
    """row, col, slope in degrees: central differences inside, one-sided at the extent's border; null next to missing pixels."""
    full = dense(pixels, rows, cols)

    def difference(part: str, order: str, size: int) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.when(F.col(order) == 0, (after - v) / res).when(F.col(order) == size - 1, (v - before) / res).otherwise((after - before) / (2 * res))

    both = full.withColumn("dx", difference("row", "col", cols)).withColumn("dy", difference("col", "row", rows))
    steep = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    return both.where("v is not null").select("row", "col", steep.alias("slope"))


def regions(pixels: DataFrame, cols: int, diagonal: bool = False) -> DataFrame:
    """row, col, v, region: connected pixels of equal value; region is the least row * cols + col."""
    key = F.col("row") * cols + F.col("col")
    named = pixels.where("v is not null").withColumn("id", key)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    next_ = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps]))
    asked = named.select(F.col("id").alias("u"), F.col("v").alias("w"), next_.alias("n")).select("u", "w", "n.row", "n.col")
    edges = asked.join(named, ["row", "col"]).where("v = w").select("u", F.col("id").alias("v"))
    return named.join(connected_components(edges), F.col("id") == F.col("node"), "left").select("row", "col", "v", F.coalesce("component", "id").alias("region"))


def region_centroids(pixels: DataFrame, cols: int, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """region, v, n, x, y: one point per connected region of values above 0."""
    named = regions(pixels.where("v > 0"), cols)
    centre = lambda c, o: F.avg((F.col(c) + 0.5) * res + o)
    return named.groupBy("region", "v").agg(F.count("*").alias("n"), centre("col", x0).alias("x"), centre("row", y0).alias("y"))


def mosaic(*tiles: DataFrame) -> DataFrame:
    """Pixels of several rasters; where they overlap the earlier raster's valid value stays."""
    out = None
    for i, t in enumerate(tiles):
        t = t.select("row", "col", "v", F.lit(i).alias("_order"))
        out = t if out is None else out.unionByName(t)
    assert out is not None
    return out.where("v is not null").groupBy("row", "col").agg(F.min_by("v", "_order").alias("v"))


def scaled(pixels: DataFrame, kind: str, top: float | None = None) -> Column:
    """A layer in [0, 1]: binary clipped, pct over 100, log_scale by its log at the 99th percentile (0 counts as 1)."""
    v = F.col("v").cast("double")
    if kind == "binary":
        out = v
    elif kind == "pct":
        out = v / 100.0
    else:
        out = F.log1p(F.greatest(v, F.lit(0.0))) / F.lit(top if top else 1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(out, F.lit(0.0))))


def window(pixels: DataFrame, minx: float, miny: float, maxx: float, maxy: float, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """The pixels that a rectangle touches, by a range of rows and columns that reaches the scan."""
    low = lambda v, o: math.floor((v - o) / res)
    high = lambda v, o: math.ceil((v - o) / res) - 1
    return pixels.where(F.col("row").between(low(miny, y0), high(maxy, y0)) & F.col("col").between(low(minx, x0), high(maxx, x0)))


def any_positive(zones: DataFrame, pixels: DataFrame, res: float, name: str = "present") -> DataFrame:
    """id and 1 if a pixel above 0 has its centre in the zone's box, else 0. Zones: id, minx to maxy."""
    centre = lambda c: (F.col(c) + 0.5) * res
    spots = sj.boxed_points(pixels.where("v > 0").select(F.struct("row", "col").alias("id"), centre("col").alias("x"), centre("row").alias("y")))
    return sj.flag_matches(zones.select("id", "minx", "miny", "maxx", "maxy"), "id", sj.box_pairs(zones, spots, 500.0), name).select("id", name)


def volume(cells: DataFrame, channels: list[str], cols: int) -> DataFrame:
    """channel, row, values: each row of each channel as an array of cols numbers, 0 where there is no cell.

    Cells: id, row, col and a column per channel. Where several cells fall on one place the last by id wins. Rows without a
    cell are left out: a reader fills them with zeros. Cells without a place, or beside the extent, don't count.
    """
    inside = F.col("row").isNotNull() & F.col("col").between(0, cols - 1)
    last = cells.where(inside).groupBy("row", "col").agg(F.max_by(F.struct(*channels), "id").alias("v")).select("row", "col", "v.*")
    long = last.unpivot(["row", "col"], [F.col(c).cast("double").alias(c) for c in channels], "channel", "value").where("value is not null")
    places = long.groupBy("channel", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    return places.select("channel", "row", F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda i: F.coalesce(F.element_at("m", i.cast(last.schema["col"].dataType)), F.lit(0.0))).alias("values"))
