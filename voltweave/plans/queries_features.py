"""Queries of the feature tables and layer recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators import sampling
from voltweave.operators import spatial_join as sj
from voltweave.plans import features, recipes
from voltweave.plans.layers import RASTER_SQL, layer, raster, with_layers
from voltweave.plans.queries_join import point_segment_sql
from voltweave.plans.registry import query

_D = "sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))"
_PL = point_segment_sql("p.x", "p.y", "s")
_ROUND = lambda df, *keep: df.select(*[F.round(c, 4).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(
    with_layers("v_pts", "v_sites", "v_lines", "v_bldg")
    + f""", a as (select p.id, min({_D}) as dist_sites, count(*) filter (where {_D} <= 450) as n_sites from v_pts p, v_sites s group by p.id), b as (select p.id, min({_PL}) as dist_grid from v_pts p, v_lines s group by p.id),
    c as (select p.id, count(s.id) as n_bldg_1km from v_pts p left join v_bldg s on {_D} <= 1000 group by p.id),
    r as (select id, n_bldg_1km, 450 - 350 * least(n_bldg_1km, 600) / cast(600 as double) as buffer_m, dist_sites, dist_grid, n_sites, n_sites as n_all from a join b using (id) join c using (id))
    select id, n_bldg_1km, round(buffer_m, 4) as buffer_m, round(dist_sites, 4) as dist_sites, round(dist_grid, 4) as dist_grid, n_sites, n_all, round(n_all / buffer_m, 4) as infra_density, round(ln(1 + dist_sites), 4) as log_dist_sites from r"""
)
def point_features(spark: SparkSession, d: str) -> DataFrame:
    """Sample points: density buffer, distances, counts, interaction terms."""
    out = features.point_features(layer(spark, d, "v_pts"), {"sites": layer(spark, d, "v_sites")}, layer(spark, d, "v_bldg"), layer(spark, d, "v_lines"))
    return _ROUND(out)


@query()
def road_features(spark: SparkSession, d: str) -> DataFrame:
    """Roads: label, distances, buildings, parcels, names. The label's buffer join has no short SQL; its parts are checked one by one."""
    out = features.road_features(layer(spark, d, "v_segs"), layer(spark, d, "v_lines"), {"sites": layer(spark, d, "v_sites"), "pts": layer(spark, d, "v_pts")}, layer(spark, d, "v_bldg"), layer(spark, d, "v_boxes"))
    return _ROUND(out)


@query()
def tile_features(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 1 km: label, blobs, shared area, building density, land cover."""
    tiles = sampling.lattice(spark, 0.0, 0.0, 20000.0, 20000.0, 1000.0).withColumnRenamed("tile_id", "id")
    return _ROUND(features.tile_features(tiles, layer(spark, d, "v_boxes"), layer(spark, d, "v_lines"), layer(spark, d, "v_bldg"), raster(spark, d), [6, 7], 100.0))


@query(
    with_layers("v_segs", "v_sites", "v_pts")
    + f""", e as (select id, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from v_segs), a as (select p.id, min({_D}) as d from e p, v_sites s group by p.id), b as (select p.id, min({_D}) as d from e p, v_pts s group by p.id)
    select a.id, round(least(a.d, b.d), 4) as dist_any from a join b using (id)"""
)
def merged_distances(spark: SparkSession, d: str) -> DataFrame:
    """The nearer of two layers' distances."""
    units = features.midpoints(layer(spark, d, "v_segs"))
    table = features.distances(units, {"sites": layer(spark, d, "v_sites"), "pts": layer(spark, d, "v_pts")})
    return features.merged_distances(table, {"any": ["sites", "pts"]}).select("id", F.round("dist_any", 4).alias("dist_any"))


@query(
    with_layers("v_segs", "v_pixels")
    + f""", {RASTER_SQL}, a as (select id, x1, y1, x2, y2, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) as len from v_segs),
    st as (select id, x1, y1, (x2 - x1) / len as ux, (y2 - y1) / len as uy, unnest(range(0, cast(floor(len / 30) as bigint) + 1)) * 30.0::double as s from a where len >= 30),
    sd as (select id, s, x1 + ux * s + k * uy * 50 as x, y1 + uy * s - k * ux * 50 as y from st, (values (1), (-1)) as k(k)),
    h as (select id, s, max(cast(v as double)) - min(cast(v as double)) as rise from sd join pix on row = floor(y / 100) and col = floor(x / 100) group by id, s having count(v) = 2),
    m as (select id, avg(abs(rise) / 100) as m from h group by id having count(*) >= 2)
    select v_segs.id, round(degrees(atan(m)), 4) as perp_slope_deg from v_segs left join m on m.id = v_segs.id"""
)
def perpendicular_slope(spark: SparkSession, d: str) -> DataFrame:
    """Mean rise across each segment, from a raster."""
    pixels = raster(spark, d).withColumn("v", F.col("v").cast("double"))
    return _ROUND(features.perpendicular_slope(layer(spark, d, "v_segs"), pixels, 0.0, 0.0, 100.0))


@query()
def network_edges(spark: SparkSession, d: str) -> DataFrame:
    """Roads outside exclusion zones, cut at crossings, as a graph."""
    edges, _ = features.network_tables(layer(spark, d, "v_segs"), layer(spark, d, "v_boxes"))
    return edges.select("edge_id", "u", "v", "highway")


@query(
    with_layers("v_sites", "v_lines", "v_boxes")
    + f""", l as (select p.id, s.nation, row_number() over (partition by p.id order by {_PL}, s.id) as k from v_sites p join v_lines s on s.id <> p.id and {_PL} <= 100),
    b as (select p.id, min(sqrt(power(greatest(s.minx - p.x, p.x - s.maxx, 0), 2) + power(greatest(s.miny - p.y, p.y - s.maxy, 0), 2))) as near_pv, sum(4 * s.h * s.h) as pv_size from v_sites p join v_boxes s on sqrt(power(greatest(s.minx - p.x, p.x - s.maxx, 0), 2) + power(greatest(s.miny - p.y, p.y - s.maxy, 0), 2)) <= 200 group by p.id)
    select p.id, cast(l.id is not null as integer) as crossing_transmission_line, cast(l.nation as double) as trans_line_voltage, round(near_pv, 4) as near_pv, coalesce(pv_size, 0) as pv_size from v_sites p left join l on p.id = l.id and k = 1 left join b on p.id = b.id"""
)
def substation_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Whether another line passes within 100 m, its value, and the fields within 200 m with their whole area."""
    subs = layer(spark, d, "v_sites")
    lines = layer(spark, d, "v_lines").withColumn("voltage_kv", F.col("nation").cast("double"))
    boxed = sj.boxed_points(subs)
    near = sj.within_distance(boxed, sj.boxed_segments(lines), 100.0, sj.point_line_distance()).where("l_id <> r_id")
    first = sj.first_match(near, [F.col("dist"), F.col("r_id")], "id").select(F.col("l_id").alias("id"), F.lit(1).alias("c"), F.col("r_voltage_kv").alias("trans_line_voltage"))
    out = recipes.enriched_substations(subs, lines, layer(spark, d, "v_boxes").withColumn("area", 4 * F.col("h") * F.col("h"))).select("id", "near_pv", "pv_size")
    return out.join(first, "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("crossing_transmission_line"), "trans_line_voltage", F.round("near_pv", 4).alias("near_pv"), "pv_size")


@query(
    with_layers("v_sites", "v_pts")
    + """, s as (select row_number() over (order by k, i) - 1 as id, x, y from (select 0 as k, id as i, x, y from v_sites union all select 1, id, x, y from v_pts)),
    pr as (select a.id as u, b.id as v from s a join s b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50), reach(u, v) as (select id, id from s union select r.u, pr.v from reach r join pr on r.v = pr.u), comp as (select u, min(v) as c from reach group by u)
    select count(distinct c) as rows, count(distinct case when s.id < (select count(*) from v_sites) then c end) as from_first from comp join s on comp.c = s.id"""
)
def recipe_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Two sources merged and deduplicated within 50 m, the first source preferred."""
    sources = {"eia_gas": layer(spark, d, "v_sites").select("x", "y"), "eia_hydro": layer(spark, d, "v_pts").select("x", "y")}
    out = recipes.build("eia_gas_hydro", sources)
    return out.agg(F.count("*").alias("rows"), F.count_if(F.col("source_file") == "eia_gas").alias("from_first"))
