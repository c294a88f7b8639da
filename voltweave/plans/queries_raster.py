"""Queries of the raster and lattice operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators import overlay
from voltweave.operators import raster as ra
from voltweave.operators import sampling
from voltweave.operators import spatial_join as sj
from voltweave.operators.ranking import quantiles
from voltweave.plans.layers import RASTER_SQL, layer, raster, with_layers
from voltweave.plans.registry import query

SIDE, RES = 200, 100.0
_P = with_layers("v_pixels", "v_sites", "v_bldg", "v_boxes") + f", {RASTER_SQL}"
_GRID = "grid as (select a.k as row, b.k as col from (select unnest(range(0, 200)) as k) a, (select unnest(range(0, 200)) as k) b), full_ as (select grid.row, grid.col, v from grid left join pix on grid.row = pix.row and grid.col = pix.col)"


@query(_P + " select z.id, round(count(*) filter (where v in (6, 7)) * 100.0 / count(v), 4) as pct from v_sites z join pix on (col + 0.5) * 100 between z.x - 800 and z.x + 800 and (row + 0.5) * 100 between z.y - 800 and z.y + 800 group by z.id")
def zonal_class_pct(spark: SparkSession, d: str) -> DataFrame:
    """Share of two classes in a square of 1600 m around each site."""
    zones = layer(spark, d, "v_sites").withColumns({"minx": F.col("x") - 800, "maxx": F.col("x") + 800, "miny": F.col("y") - 800, "maxy": F.col("y") + 800})
    return ra.zonal_share(zones, raster(spark, d), [6, 7], RES).select("id", F.round("pct", 4).alias("pct"))


@query(_P + " select z.id, round(coalesce(count(*) filter (where v in (6, 7)) / nullif(count(v), 0)::double, 0), 6) as share from v_sites z left join pix on (col - floor(z.x / 100)) * (col - floor(z.x / 100)) + (row - floor(z.y / 100)) * (row - floor(z.y / 100)) <= 49 group by z.id")
def disc_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of two classes among the valid pixels within seven pixels of each site."""
    row, col = ra.pixel_of(F.col("x"), F.col("y"), 0.0, 0.0, RES)
    points = layer(spark, d, "v_sites").select("id", row.alias("row"), col.alias("col"))
    return ra.disc_share(points, raster(spark, d), SIDE, SIDE, 7, [6, 7]).select("id", F.round("share", 6).alias("share"))


@query(_P + " select a.row, a.col, round(a.v - avg(b.v), 6) as tpi from pix a join pix b on b.row between a.row - 3 and a.row + 3 and b.col between a.col - 3 and a.col + 3 group by a.row, a.col, a.v")
def box_mean_tpi(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel less the mean of the 7 x 7 box around it, by a summed-area table."""
    return ra.position_index(raster(spark, d), SIDE, SIDE, 3).select("row", "col", F.round("tpi", 6).alias("tpi"))


_DIFF = "case when {o} = 0 then (lead(v) over w_{o} - v) / 100.0 when {o} = 199 then (v - lag(v) over w_{o}) / 100.0 else (lead(v) over w_{o} - lag(v) over w_{o}) / 200.0 end"


@query(_P + f", {_GRID}, df as (select row, col, v, {_DIFF.format(o='col')} as dx, {_DIFF.format(o='row')} as dy from full_ window w_col as (partition by row order by col), w_row as (partition by col order by row)) select row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) as slope from df where v is not null")
def gradient_slope(spark: SparkSession, d: str) -> DataFrame:
    return ra.slope(raster(spark, d), SIDE, SIDE, RES).select("row", "col", F.round("slope", 6).alias("slope"))


@query(_P + ", r as (select z.id, min(sqrt((z.x - (col + 0.5) * 100) * (z.x - (col + 0.5) * 100) + (z.y - (row + 0.5) * 100) * (z.y - (row + 0.5) * 100))) as dist from v_sites z, pix where v = 7 group by z.id) select id, round(dist, 4) as dist from r")
def nearest_on_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Distance from each site to the nearest pixel that is on: the distance transform, sampled."""
    on = raster(spark, d).where("v = 7").select((F.col("row") * SIDE + F.col("col")).alias("id"), ((F.col("col") + 0.5) * RES).alias("x"), ((F.col("row") + 0.5) * RES).alias("y"))
    near = sj.k_nearest(sj.boxed_points(layer(spark, d, "v_sites")), sj.boxed_points(on), cell=RES)
    return near.select(F.col("l_id").alias("id"), F.round("dist", 4).alias("dist"))


_ON = "on_ as (select row * 200 + col as id, row, col from pix where v = 4)"
_REACH = "reach(u, v) as (select id, id from on_ union select r.u, nb.v from reach r join nb on r.v = nb.u), comp as (select u, min(v) as c from reach group by u)"


@query(_P + f", {_ON}, nb as (select a.id as u, b.id as v from on_ a join on_ b on abs(a.row - b.row) + abs(a.col - b.col) = 1), {_REACH} select c as region, count(*) as n, round(avg((col + 0.5) * 100.0), 4) as x, round(avg((row + 0.5) * 100.0), 4) as y from comp join on_ on comp.u = on_.id group by c")
def raster_regions(spark: SparkSession, d: str) -> DataFrame:
    """Centroid of every edge-connected region of one class."""
    out = ra.region_centroids(raster(spark, d).where("v = 4"), SIDE, RES)
    return out.select("region", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_P + f", {_ON}, nb as (select a.id as u, b.id as v from on_ a join on_ b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and a.id <> b.id), {_REACH}, sz as (select c, count(*) as n from comp group by c) select count(*) as fields, round(avg(n) * 10000, 4) as mean_field_size_m2 from sz")
def mean_field_size(spark: SparkSession, d: str) -> DataFrame:
    """Mean area of the regions of one class, corners connecting."""
    named = ra.regions(raster(spark, d).where("v = 4"), SIDE, diagonal=True)
    return named.groupBy("region").agg(F.count("*").alias("n")).agg(F.count("*").alias("fields"), F.round(F.avg("n") * 10000, 4).alias("mean_field_size_m2"))


@query(_P + ", b as (select cast(o_orderkey % 230 as bigint) as row, cast(o_custkey % 230 as bigint) as col, count(*) as v from orders group by 1, 2) select coalesce(p.row, b.row) as row, coalesce(p.col, b.col) as col, cast(coalesce(p.v, b.v) as bigint) as v from pix p full join b on p.row = b.row and p.col = b.col")
def raster_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping rasters, the first one winning."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    second = orders.groupBy((F.col("o_orderkey") % 230).alias("row"), (F.col("o_custkey") % 230).alias("col")).agg(F.count("*").alias("v"))
    return ra.mosaic(raster(spark, d).withColumn("v", F.col("v").cast("long")), second)


@query(_P + " select b.id, v from v_bldg b left join pix on pix.row = floor(b.y / 100) and pix.col = floor(b.x / 100)")
def raster_point_sample(spark: SparkSession, d: str) -> DataFrame:
    return ra.sample(layer(spark, d, "v_bldg"), raster(spark, d), 0.0, 0.0, RES).select("id", "v")


@query(_P + " select distinct row, col, v from pix join v_boxes z on (col + 0.5) * 100 between z.minx and z.maxx and (row + 0.5) * 100 between z.miny and z.maxy")
def raster_mask_clip(spark: SparkSession, d: str) -> DataFrame:
    """The pixels whose centre lies in one of the boxes."""
    points = sj.boxed_points(raster(spark, d).withColumns({"id": F.col("row") * SIDE + F.col("col"), "x": (F.col("col") + 0.5) * RES, "y": (F.col("row") + 0.5) * RES}))
    return sj.with_match(points, "id", sj.box_pairs(points, layer(spark, d, "v_boxes"), 200.0)).select("row", "col", "v")


@query("with q as (select ln(1 + quantile_cont(l_quantity, 0.99)) as top from lineitem) select l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, ln(1 + greatest(l_quantity, 0)) / top)), 6) as v from lineitem, q")
def raster_norm(spark: SparkSession, d: str) -> DataFrame:
    """A column scaled by its log at the 99th percentile, clipped to [0, 1]."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))
    top = math.log1p(quantiles(rows, ["v"], [0.99]).get("v", [0.0])[0])
    return rows.select("l_orderkey", "l_linenumber", F.round(ra.scaled(rows, "log_scale", top), 6).alias("v"))


@query("with recursive a as (select unnest(range(0, 40)) as i), t as (select x.i as i, y.i as j, x.i * 500.0::double as minx, y.i * 500.0::double as miny from a x, a y) select row_number() over (order by i, j) - 1 as tile_id, minx, miny from t")
def tile_lattice(spark: SparkSession, d: str) -> DataFrame:
    """The 500 m tiles of the extent, numbered column by column."""
    return sampling.lattice(spark, 0.0, 0.0, 20000.0, 20000.0, 500.0).select("tile_id", "minx", "miny")


@query(
    with_layers("v_bldg")
    + """, t as (select distinct cast(floor(x / 250) as bigint) as col, cast(floor((20000 - y) / 250) as bigint) as row from v_bldg),
    s as (select unnest(range(0, 65, 16)) as k), p as (select a.k as r0, b.k as c0 from s a, s b where a.k + 16 <= 80 and b.k + 16 <= 80)
    select r0, c0, count(*) as n from p join t on row >= r0 and row < r0 + 16 and col >= c0 and col < c0 + 16 group by r0, c0 having count(*) >= 0.6 * 256"""
)
def patch_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 16 x 16 tiles, 16 apart, that are 60 % full at least."""
    tiles = layer(spark, d, "v_bldg").select(F.floor(F.col("x") / 250).alias("col"), F.floor((20000 - F.col("y")) / 250).alias("row")).distinct()
    return sampling.patches(tiles, 80, 80, size=16, stride=16, coverage=0.6).select("r0", "c0", "n")


_HASH = "(cast({k} as bigint) * 2654435761) % 4294967296"


@query(f"with l as (select c_custkey as id, cast(c_acctbal > 5000 as integer) as label, {_HASH.format(k='c_custkey')} as h from customer), r as (select *, row_number() over (partition by label order by h, id) as k from l), m as (select min(n) as least_ from (select count(*) as n from l group by label)) select id, label from r, m where k <= least_")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """As many rows of each label as the rarer one has, picked by an arithmetic hash."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 5000).cast("int").alias("label"))
    return sampling.balanced(rows, "label", "id")


@query(f"with b as (select distinct floor(row / 25) as br, floor(col / 25) as bc from (select l_orderkey % 200 as row, l_partkey % 200 as col from lineitem)), r as (select br, bc, row_number() over (order by ({_HASH.format(k='br * 100003 + bc')}), br, bc) as k, count(*) over () as n from b) select cast(br as bigint) as br, cast(bc as bigint) as bc, case when k <= greatest(1, floor(n * 0.15)) then 'val' else 'train' end as part from r")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    """Spatial blocks of 25 x 25 pixels dealt to training and validation."""
    return sampling.block_split(raster(spark, d), 25, 0.15)


@query("select n_nationkey as id, cast(greatest(100, floor(800 * (n_nationkey * 137.5) / 1000 * 1.5)) as bigint) as n from nation")
def sample_budget(spark: SparkSession, d: str) -> DataFrame:
    """Samples by area: 800 in 1000 km2, by half more, 100 at least."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 137.5).alias("area"))
    return rows.select("id", sampling.budget(F.col("area"), 800, 1.5, 100).alias("n"))


@query()
def samples_along_lines(spark: SparkSession, d: str) -> DataFrame:
    """Points near the lines, as many as their length asks for, moved aside by up to 450 m; drawn by hashes."""
    return sampling.along_lines(layer(spark, d, "v_lines"), 2000, 450.0)


@query(_P + " select row, col, v from pix where row between 12 and 58 and col between 30 and 99")
def raster_window(spark: SparkSession, d: str) -> DataFrame:
    """The pixels that a rectangle touches."""
    return ra.window(raster(spark, d), 3000.0, 1250.0, 10000.0, 5801.0, RES)


@query(_P + " select z.id, cast(count(p.v) > 0 as integer) as present from v_boxes z left join (select * from pix where v > 0) p on (p.col + 0.5) * 100 between z.minx and z.maxx and (p.row + 0.5) * 100 between z.miny and z.maxy group by z.id")
def box_any_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Whether any pixel above 0 lies in a box."""
    return ra.any_positive(layer(spark, d, "v_boxes"), raster(spark, d), RES)


@query(
    "with c as (select o_orderkey as id, o_custkey % 40 as row, o_orderkey % 50 as col, o_totalprice as price, cast(o_orderkey % 3 as double) as rank from orders), l as (select row, col, arg_max(price, id) as price, arg_max(rank, id) as rank from c group by row, col), u as (select 'price' as channel, row, col, price as value from l union all select 'rank', row, col, rank from l)"
    " select channel, row, col, value from u where value <> 0"
)
def tensor_volume(spark: SparkSession, d: str) -> DataFrame:
    """Two channels on a grid of 40 x 50 cells, the last order of each cell winning; its entries other than 0."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    cells = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("row"), (F.col("o_orderkey") % 50).alias("col"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 3).cast("double").alias("rank"))
    full = ra.volume(cells, ["price", "rank"], 50).select("channel", "row", F.posexplode("values").alias("c", "value"))
    return full.where("value <> 0").select("channel", "row", F.col("c").cast("long").alias("col"), "value")


@query(
    with_layers("v_boxes")
    + """, g as (select unnest(range(0, 40)) as k), t as (select a.k * 40 + b.k as id, a.k * 500.0::double as minx, b.k * 500.0::double as miny, a.k * 500.0::double + 500 as maxx, b.k * 500.0::double + 500 as maxy from g a, g b),
    h as (select distinct t.id, greatest(t.minx, b.minx) as x0, least(t.maxx, b.maxx) as x1, greatest(t.miny, b.miny) as y0, least(t.maxy, b.maxy) as y1 from t join v_boxes b on b.minx < t.maxx and b.maxx > t.minx and b.miny < t.maxy and b.maxy > t.miny),
    e as (select distinct id, unnest([y0, y1]) as a from h), s as (select id, a, lead(a) over (partition by id order by a) as b from e),
    c as (select s.id, s.a, s.b, x0, x1, max(x1) over (partition by s.id, s.a order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from s join h on s.id = h.id and y0 <= s.a and y1 >= s.b where s.b is not null),
    f as (select id, sum((b - a) * greatest(0, x1 - greatest(x0, coalesce(reach, x0)))) / 250000 as share from c group by id)
    select t.id, round(coalesce(share, 0), 8) as share, coalesce(share, 0) >= 0.05 as kept, coalesce(share, 0) < 0.3 as free from t left join f using (id)"""
)
def tile_covered_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of each 500 m tile that the union of boxes covers, and the two filters by it."""
    tiles = sampling.lattice(spark, 0.0, 0.0, 20000.0, 20000.0, 500.0).select(F.col("tile_id").alias("id"), "minx", "miny", "maxx", "maxy")
    boxes = layer(spark, d, "v_boxes")
    kept, free = (f(tiles, boxes, 500.0, n).select("id").withColumn(c, F.lit(True)) for f, n, c in ((overlay.in_extent, 0.05, "kept"), (overlay.not_excluded, 0.3, "free")))
    out = overlay.covered_share(tiles, boxes, 500.0).select("id", F.round("share", 8).alias("share")).join(kept, "id", "left").join(free, "id", "left")
    return out.na.fill(False, ["kept", "free"])


@query()
def training_points(spark: SparkSession, d: str) -> DataFrame:
    """Balanced training points near and away from the lines, drawn along lines and segments and in large boxes."""
    area = layer(spark, d, "v_sites").select("id", (F.col("x") - 4000).alias("minx"), (F.col("y") - 4000).alias("miny"), (F.col("x") + 4000).alias("maxx"), (F.col("y") + 4000).alias("maxy"))
    return sampling.training_points(spark, area, layer(spark, d, "v_lines"), layer(spark, d, "v_segs"), layer(spark, d, "v_bldg"), 400.0)
