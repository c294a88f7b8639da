"""Lattices, samples and splits, all drawn by hashes so that reruns and other partitionings agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.functions import geometry as g
from voltweave.operators import aggregate
from voltweave.operators import spatial_join as sj
from voltweave.operators.ranking import dense_rank_global, rank_within, running_totals
from voltweave.session import materialise


def mixed(key: Column) -> Column:
    """A multiplicative hash in plain integer arithmetic, the same in any engine."""
    return F.pmod(key.cast("long") * F.lit(2654435761), F.lit(4294967296))


def unit(salt: int, *key: str) -> Column:
    """A number in [0, 1) from the key."""
    return F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def lattice(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, tile: float) -> DataFrame:
    """tile_id, i, j, minx, miny, maxx, maxy of the square tiles over an extent, x outer, y inner, numbered from 0."""
    nx, ny = math.ceil((maxx - minx) / tile), math.ceil((maxy - miny) / tile)
    i, j = F.floor(F.col("id") / ny).cast("long"), F.pmod(F.col("id"), F.lit(ny))
    x, y = F.lit(minx) + i * tile, F.lit(miny) + j * tile
    return spark.range(nx * ny).select(F.col("id").alias("tile_id"), i.alias("i"), j.alias("j"), x.alias("minx"), y.alias("miny"), (x + tile).alias("maxx"), (y + tile).alias("maxy"))


def grid_points(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, step: float, zones: DataFrame) -> DataFrame:
    """The lattice's points that lie in one of the boxes."""
    points = sj.boxed_points(lattice(spark, minx, miny, maxx, maxy, step).select(F.col("tile_id").alias("id"), F.col("minx").alias("x"), F.col("miny").alias("y")))
    return sj.with_match(points, "id", sj.box_pairs(points, zones, max(step, 200.0))).select("id", "x", "y")


def renumbered(df: DataFrame, order: list[Column], name: str, pattern: str | None = None) -> DataFrame:
    """Numbers rows from 0 in an order, or gives them sequential ids such as R_%06d."""
    out = dense_rank_global(df, order, name)
    return out.withColumn(name, F.format_string(pattern, F.col(name))) if pattern else out


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each label as the rarest has, those with the smallest hash of the key."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return rank_within(rows, label, [mixed(F.col(key)), F.col(key)], "_k").where(F.col("_k") < least).select(*rows.columns)


def block_split(cells: DataFrame, size: int, share: float) -> DataFrame:
    """br, bc, part: blocks of size x size cells, the share of them (one at least) with the smallest hashes as val."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    blocks = cells.select(at("row").alias("br"), at("col").alias("bc")).distinct()
    ranked = dense_rank_global(blocks, [mixed(F.col("br") * 100003 + F.col("bc")), F.col("br"), F.col("bc")], "_k")
    val = F.col("_k") < max(1, math.floor(ranked.count() * share))
    return ranked.select("br", "bc", F.when(val, "val").otherwise("train").alias("part"))


def patches(tiles: DataFrame, rows: int, cols: int, size: int, stride: int, coverage: float, block: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """r0, c0, n: windows that are covered to a share at least; with a block split, only those whose cells are all of one part.

    Purity is judged on all cells of the window, empty ones too, so from its blocks and not from the tiles in it.
    """
    k = lambda c, limit: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)), F.least(F.floor(F.col(c) / stride), F.lit((limit - size) // stride))))
    inside = (F.col("row") >= 0) & (F.col("row") <= (rows - size) // stride * stride + size - 1) & (F.col("col") >= 0) & (F.col("col") <= (cols - size) // stride * stride + size - 1)
    fits = F.ceil((F.col("row") - size + 1) / stride) <= F.floor(F.col("row") / stride)
    fits = fits & (F.ceil((F.col("col") - size + 1) / stride) <= F.floor(F.col("col") / stride))
    windows = tiles.where(inside & fits).withColumn("r0", k("row", rows)).withColumn("c0", k("col", cols)).withColumns({"r0": F.col("r0") * stride, "c0": F.col("c0") * stride})
    full = windows.groupBy("r0", "c0").agg(F.count("*").alias("n")).where(F.col("n") >= coverage * size * size)
    if parts is None or block is None:
        return full
    last = lambda c: F.floor((F.col(c) + size - 1) / block).cast("long")
    over = full.withColumn("br", F.explode(F.sequence(F.floor(F.col("r0") / block).cast("long"), last("r0")))).withColumn("bc", F.explode(F.sequence(F.floor(F.col("c0") / block).cast("long"), last("c0"))))
    pure = over.join(parts, ["br", "bc"], "left").withColumn("part", F.coalesce("part", F.lit("train"))).groupBy("r0", "c0", "n").agg(F.min("part").alias("part"), F.max("part").alias("other"))
    return pure.where("part = other").drop("other")


def budget(area_km2: Column, per_1000: float, factor: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor(F.lit(per_1000) * area_km2 / 1000 * factor)).cast("long")


def along_lines(lines: DataFrame, n: int, radius: float) -> DataFrame:
    """k, line_id, x, y: n samples on lines, drawn by length with replacement, moved by up to radius at any angle.

    Sample k lies at a place drawn from the running length of all lines (in the order of their ids). The running length is cut
    into as many cells as there are lines; lines and samples meet by cell, so no range join is needed. Lines without a length
    get no sample, and where none has one there are none.
    """
    own = lines.select("id", "x1", "y1", "x2", "y2").withColumn("len", g.segment_length()).where("len > 0")
    upto = running_totals(own, [F.col("id")], {"len": "_upto"})
    size = upto.agg(F.max("_upto").alias("total"), F.count("*").alias("n")).first()
    if not size["n"]:
        return lines.select(F.lit(0).cast("long").alias("k"), F.col("id").alias("line_id"), F.col("x1").alias("x"), F.col("y1").alias("y")).limit(0)
    cell = F.lit(size["total"] / size["n"])
    at_cell = lambda c: F.least(F.floor(c / cell), F.lit(size["n"] - 1))
    upto = upto.withColumn("_from", F.col("_upto") - F.col("len"))
    spread = upto.select("_from", "_upto", F.explode(F.sequence(at_cell(F.col("_from")), at_cell(F.col("_upto")))).alias("_cell"))
    draws = lines.sparkSession.range(n).select(F.col("id").alias("k"), (unit(1, "id") * size["total"]).alias("_at"))
    hit = draws.withColumn("_cell", at_cell(F.col("_at"))).join(spread, "_cell").where("_at >= _from and _at < _upto")
    # rounding may leave a sample between two lines, or with both: its line is the first that reaches it
    first = draws.join(hit.groupBy("k").agg(F.min("_upto").alias("_upto")), "k", "left").withColumn("_upto", F.coalesce("_upto", F.lit(size["total"])))
    picked = materialise(first, "line-samples").join(upto, "_upto").dropDuplicates(["k"])
    spot = g.interpolate("x1", "y1", "x2", "y2", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_at") - F.col("_from")) / F.col("len"))))
    angle, r = unit(3, "k") * 2 * math.pi, unit(4, "k") * radius
    return picked.withColumn("_p", spot).select("k", F.col("id").alias("line_id"), (F.col("_p.x") + r * F.cos(angle)).alias("x"), (F.col("_p.y") + r * F.sin(angle)).alias("y"))


def in_polygons(spark: SparkSession, zones: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n points drawn uniformly in the union of boxes' envelope and kept where a box holds them, the first n by number.

    Over-generates in rounds until n are found; fails if that takes 12, each four times the one before. Without a box there are none.
    """
    box = zones.agg(F.min("minx").alias("a"), F.min("miny").alias("b"), F.max("maxx").alias("c"), F.max("maxy").alias("d")).first()
    if box["a"] is None or n == 0:
        return spark.createDataFrame([], "id long, x double, y double")
    found, start, size = None, 0, 3 * n
    for _ in range(12):
        draws = spark.range(start, start + size)
        points = sj.boxed_points(draws.select("id", (F.lit(box["a"]) + unit(seed, "id") * (box["c"] - box["a"])).alias("x"), (F.lit(box["b"]) + unit(seed + 1, "id") * (box["d"] - box["b"])).alias("y")))
        kept = sj.with_match(points, "id", sj.box_pairs(points, zones, sj.fitting_cell(zones, 500.0))).select("id", "x", "y")
        found = kept if found is None else found.unionByName(kept)
        if found.count() >= n:
            break
        start, size = start + size, size * 4
    else:
        raise ValueError(f"the boxes cover too little of their envelope: {start} draws gave fewer than {n} points")
    return found.orderBy("id").limit(n)


def training_points(spark: SparkSession, area: DataFrame, grid: DataFrame, roads: DataFrame, buildings: DataFrame, area_km2: float, per_1000: tuple[float, float, float] = (800.0, 800.0, 500.0), factor: float = 1.5, least: int = 100) -> DataFrame:
    """point_id, x, y, buffer_m, label: as many points near the grid as away from it, from three draws.

    Points are drawn along grid lines, along roads, and in the boxes of the area; those outside the area go. Buildings within
    1 km set a point's buffer, from 450 m for none to 100 m for 600 and more; a point whose buffer reaches a grid line has
    label 1. Of the more frequent label the rows with the least hashes stay. All draws are hashes, so reruns agree.
    """
    count = [max(least, math.floor(p * area_km2 / 1000 * factor)) for p in per_1000]
    drawn = [
        along_lines(grid, count[0], 50.0).select(F.lit(0).alias("kind"), "k", "x", "y"),
        along_lines(roads, count[1], 50.0).select(F.lit(1).alias("kind"), "k", "x", "y"),
        in_polygons(spark, area, count[2]).select(F.lit(2).alias("kind"), F.col("id").alias("k"), "x", "y"),
    ]
    points = sj.boxed_points(drawn[0].unionByName(drawn[1]).unionByName(drawn[2]).withColumn("id", F.col("k") * 3 + F.col("kind")))
    points = materialise(sj.with_match(points, "id", sj.box_pairs(points, area, sj.fitting_cell(area, 500.0))), "training-points")
    homes = sj.radius_count(points, buildings, 1000.0)
    homes = homes.withColumn("buffer_m", aggregate.interpolated(F.col("n"), 0, 600, 450.0, 100.0))
    near = sj.within_distance(points, sj.boxed_segments(grid), 450.0, sj.point_line_distance()).groupBy(F.col("l_id").alias("id")).agg(F.min("dist").alias("dist"))
    label = F.coalesce((F.col("dist") <= F.col("buffer_m")).cast("int"), F.lit(0))
    rows = homes.join(near, "id", "left").select(F.col("id").alias("point_id"), "x", "y", "buffer_m", label.alias("label"))
    return balanced(materialise(rows, "training-points"), "label", "point_id")
