"""Queries of the spatial joins, overlays and point clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltweave.functions import geometry as g
from voltweave.operators import aggregate as agg
from voltweave.operators import clustering, coverage, overlay
from voltweave.operators import spatial_join as sj
from voltweave.plans.layers import layer, with_layers
from voltweave.plans.registry import query

TILE = 500.0

_TILES_SQL = "tiles as (select cast(floor(x / 500) as bigint) as i, cast(floor(y / 500) as bigint) as j, count(*) as n from v_bldg group by 1, 2)"


@query(with_layers("v_bldg") + f", {_TILES_SQL} select i, j, n from tiles")
def tile_assign_count(spark: SparkSession, d: str) -> DataFrame:
    return clustering.tile_counts(layer(spark, d, "v_bldg"), TILE)


_REACH_SQL = """dense as (select i, j, n from tiles where n > (select quantile_cont(n, 0.75) from tiles)),
ids as (select i, j, i * 100000 + j as id from dense),
nb as (select a.id as u, b.id as v from ids a join ids b on (abs(a.i - b.i) + abs(a.j - b.j) = 1)),
reach(u, v) as (select id, id from ids union select r.u, nb.v from reach r join nb on r.v = nb.u),
comp as (select u, min(v) as c from reach group by u)"""


@query(with_layers("v_bldg") + f", {_TILES_SQL}, {_REACH_SQL}, sized as (select c, count(*) as size from comp group by c) select ids.i, ids.j, comp.c as component, cast(size as bigint) as size from ids join comp on ids.id = comp.u join sized using (c) where size >= 3")
def tile_rook_components(spark: SparkSession, d: str) -> DataFrame:
    """Dense tiles whose edge-connected component has three tiles at least: the urban exclusion zones."""
    return clustering.dense_components(clustering.tile_counts(layer(spark, d, "v_bldg"), TILE), share=0.75, least=3)


_IN_BOX = "p.x between b.minx and b.maxx and p.y between b.miny and b.maxy"


def _points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    return sj.box_pairs(sj.boxed_points(layer(spark, d, "v_pts")), layer(spark, d, "v_boxes"), 200.0)


@query(with_layers("v_pts", "v_boxes") + f" select p.id as point_id, b.id as box_id, b.val from v_pts p join v_boxes b on {_IN_BOX}")
def sjoin_point_in_box(spark: SparkSession, d: str) -> DataFrame:
    return _points_in_boxes(spark, d).select(F.col("l_id").alias("point_id"), F.col("r_id").alias("box_id"), F.col("r_val").alias("val"))


_TOUCH = "a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy"


@query(with_layers("v_boxes") + f" select a.id as a_id, b.id as b_id from v_boxes a join v_boxes b on a.id < b.id and {_TOUCH}")
def sjoin_box_box_intersects(spark: SparkSession, d: str) -> DataFrame:
    boxes = layer(spark, d, "v_boxes")
    return sj.box_pairs(boxes, boxes, 200.0).where("l_id < r_id").select(F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id"))


@query(with_layers("v_pts", "v_boxes") + f" select b.id, count(p.id) as n from v_boxes b left join v_pts p on {_IN_BOX} group by b.id")
def sjoin_left_count(spark: SparkSession, d: str) -> DataFrame:
    boxes = layer(spark, d, "v_boxes")
    pairs = sj.box_pairs(boxes, sj.boxed_points(layer(spark, d, "v_pts")), 200.0)
    return sj.count_matches(boxes, "id", pairs).select("id", "n")


@query(with_layers("v_boxes", "v_pts") + f" select b.id, cast(exists (select 1 from v_pts p where {_IN_BOX}) as integer) as hit from v_boxes b")
def semi_touch_flag(spark: SparkSession, d: str) -> DataFrame:
    boxes = layer(spark, d, "v_boxes")
    pairs = sj.box_pairs(boxes, sj.boxed_points(layer(spark, d, "v_pts")), 200.0)
    return sj.flag_matches(boxes, "id", pairs).select("id", "hit")


@query(with_layers("v_pts", "v_boxes") + f" select p.id from v_pts p where not exists (select 1 from v_boxes b where {_IN_BOX})")
def anti_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return sj.without_match(layer(spark, d, "v_pts"), "id", _points_in_boxes(spark, d)).select("id")


_D = "sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return sj.boxed_points(layer(spark, d, "v_sites"))


def _pts(spark: SparkSession, d: str) -> DataFrame:
    return sj.boxed_points(layer(spark, d, "v_pts"))


def _ranked(sql: str, k: int, where: str = "") -> str:
    return with_layers("v_pts", "v_sites") + f", r as (select p.id as id, s.id as site_id, {_D} as d, row_number() over (partition by p.id order by {_D}, s.id) as rank from v_pts p, v_sites s {where}) {sql} from r where rank <= {k}"


@query(_ranked("select id, site_id, round(d, 4) as dist", 1))
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    near = sj.k_nearest(_pts(spark, d), _sites(spark, d), cell=500.0)
    return near.select(F.col("l_id").alias("id"), F.col("r_id").alias("site_id"), F.round("dist", 4).alias("dist"))


@query(_ranked("select id, site_id, round(d, 4) as dist", 1, f"where {_D} <= 600"))
def nearest_site_capped(spark: SparkSession, d: str) -> DataFrame:
    near = sj.k_nearest(_pts(spark, d), _sites(spark, d), cell=600.0, most=600.0)
    return near.select(F.col("l_id").alias("id"), F.col("r_id").alias("site_id"), F.round("dist", 4).alias("dist"))


@query(_ranked("select id, site_id, round(d, 4) as dist, cast(rank as integer) as rank", 3))
def knn3_sites(spark: SparkSession, d: str) -> DataFrame:
    near = sj.k_nearest(_pts(spark, d), _sites(spark, d), k=3, cell=1000.0)
    return near.select(F.col("l_id").alias("id"), F.col("r_id").alias("site_id"), F.round("dist", 4).alias("dist"), F.col("rank").cast("int").alias("rank"))


def point_segment_sql(px: str, py: str, s: str) -> str:
    """The SQL of functions.geometry.point_segment_distance."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(case when {sq} = 0 then 0.0 else greatest(0.0, least(1.0, (({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({sq}, 0))) end)"
    ex, ey = f"({px} - ({s}.x1 + {t} * {dx}))", f"({py} - ({s}.y1 + {t} * {dy}))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


_PL = point_segment_sql("p.x", "p.y", "s")


@query(with_layers("v_pts", "v_lines") + f", r as (select p.id, min({_PL}) as d from v_pts p, v_lines s group by p.id) select id, round(d, 4) as dist from r")
def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    lines = sj.boxed_segments(layer(spark, d, "v_lines"))
    near = sj.k_nearest(_pts(spark, d), lines, cell=500.0, d=sj.point_line_distance)
    return near.select(F.col("l_id").alias("id"), F.round("dist", 4).alias("dist"))


@query(with_layers("v_pts", "v_lines") + f", r as (select p.id, min({_PL}) filter (where {_PL} <= 675) as d from v_pts p, v_lines s group by p.id) select id, round(coalesce(d, 9999.0), 4) as dist from r")
def line_distance_or_default(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest line within 675 m, else 9999."""
    pts = _pts(spark, d)
    lines = sj.boxed_segments(layer(spark, d, "v_lines"))
    near = sj.within_distance(pts, lines, 675.0, sj.point_line_distance()).groupBy(F.col("l_id").alias("id")).agg(F.min("dist").alias("d"))
    return pts.join(near, "id", "left").select("id", F.round(F.coalesce("d", F.lit(9999.0)), 4).alias("dist"))


_BD = "((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y))"


@query(with_layers("v_pts", "v_bldg") + f" select p.id, count(b.id) as n from v_pts p left join v_bldg b on sqrt({_BD}) <= 1000 group by p.id")
def radius_count_1km(spark: SparkSession, d: str) -> DataFrame:
    pts = _pts(spark, d)
    return sj.radius_count(pts, layer(spark, d, "v_bldg"), 1000.0).select("id", "n")


@query(
    with_layers("v_pts", "v_bldg", "v_lines")
    + f""", c as (select p.id, p.x, p.y, count(b.id) as n from v_pts p left join v_bldg b on sqrt({_BD}) <= 1000 group by p.id, p.x, p.y),
    l as (select p.id, min({_PL}) as dist from c p, v_lines s group by p.id)
    select c.id, n, 450 - 350 * least(greatest(n, 0), 600) / 600.0 as buffer, cast(dist <= 450 - 350 * least(greatest(n, 0), 600) / 600.0 as integer) as grid from c join l using (id)"""
)
def dynamic_buffer_label(spark: SparkSession, d: str) -> DataFrame:
    """Buffer of 450 m shrinking to 100 m with the buildings around, and whether a line lies within it."""
    counted = radius_count_1km(spark, d)
    lines = sj.k_nearest(_pts(spark, d), sj.boxed_segments(layer(spark, d, "v_lines")), cell=500.0, d=sj.point_line_distance)
    lines = lines.select(F.col("l_id").alias("id"), "dist")
    buffer = agg.interpolated(F.col("n"), 0, 600, 450.0, 100.0)
    return counted.withColumn("buffer", buffer).join(lines, "id").select("id", "n", "buffer", (F.col("dist") <= F.col("buffer")).cast("int").alias("grid"))


_AREA = "greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0)"


@query(with_layers("v_boxes") + f" select a.id, round(coalesce(sum(case when b.id is not null then {_AREA} end), 0), 4) as area from v_boxes a left join v_boxes b on a.id <> b.id and {_TOUCH} group by a.id")
def box_overlap_area_sum(spark: SparkSession, d: str) -> DataFrame:
    """Area shared with other boxes, summed without union, so it may exceed the box."""
    boxes = layer(spark, d, "v_boxes")
    area = sj.box_pairs(boxes, boxes, 200.0).where("l_id <> r_id").groupBy(F.col("l_id").alias("id")).agg(F.sum(g.overlap_area()).alias("area"))
    return boxes.select("id").join(area, "id", "left").select("id", F.round(F.coalesce("area", F.lit(0.0)), 4).alias("area"))


def clip_sql(s: str, b: str) -> tuple[str, str]:
    """The SQL of functions.geometry.clip_interval."""
    low, high = ["0.0"], ["1.0"]
    for c in "xy":
        a, dd = f"{s}.{c}1", f"({s}.{c}2 - {s}.{c}1)"
        lo, hi = f"{b}.min{c}", f"{b}.max{c}"
        out = f"{dd} = 0 and ({a} < {lo} or {a} > {hi})"
        near, far = f"({lo} - {a}) / nullif({dd}, 0)", f"({hi} - {a}) / nullif({dd}, 0)"
        low.append(f"case when {out} then 2.0 else coalesce(least({near}, {far}), 0.0) end")
        high.append(f"case when {out} then -1.0 else coalesce(greatest({near}, {far}), 1.0) end")
    return f"greatest({', '.join(low)})", f"least({', '.join(high)})"


_LO, _HI = clip_sql("s", "t")
_LEN = "sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))"
_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT = ", ".join(f"round(coalesce(sum(len) filter (where highway = '{c}'), 0), 4) as road_m__{c[0]}" for c in _CLASSES)


@query(
    with_layers("v_segs")
    + f""", g as (select unnest(range(-1, 41)) as k), t as (select a.k as i, b.k as j, a.k * 500.0 as minx, b.k * 500.0 as miny, a.k * 500.0 + 500 as maxx, b.k * 500.0 + 500 as maxy from g a, g b),
    c as (select t.i, t.j, s.highway, ({_HI} - {_LO}) * {_LEN} as len from v_segs s join t on least(s.x1, s.x2) <= t.maxx and greatest(s.x1, s.x2) >= t.minx and least(s.y1, s.y2) <= t.maxy and greatest(s.y1, s.y2) >= t.miny where {_HI} > {_LO})
    select i, j, {_PIVOT} from c where len > 0 group by i, j"""
)
def seg_box_clip_length_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Road metres per tile and class: segments clipped to 500 m tiles, summed, pivoted over fixed classes."""
    return overlay.tile_lengths(layer(spark, d, "v_segs"), TILE, "highway", {c: f"road_m__{c[0]}" for c in _CLASSES})


@query(
    with_layers("v_segs", "v_boxes")
    + f""", iv as (select s.id, {_LO.replace("t.", "b.")} as lo, {_HI.replace("t.", "b.")} as hi from v_segs s join v_boxes b on least(s.x1, s.x2) <= b.maxx and greatest(s.x1, s.x2) >= b.minx and least(s.y1, s.y2) <= b.maxy and greatest(s.y1, s.y2) >= b.miny),
    ok as (select * from iv where lo < hi),
    m as (select id, lo, hi, max(hi) over (partition by id order by lo, hi rows between unbounded preceding and 1 preceding) as before from ok),
    f as (select id, sum(greatest(0, hi - greatest(lo, coalesce(before, 0)))) as frac from m group by id)
    select s.id, round(coalesce(frac, 0), 6) as frac, cast(coalesce(frac, 0) >= 0.5 as integer) as label from v_segs s left join f using (id)"""
)
def line_union_overlap_frac(spark: SparkSession, d: str) -> DataFrame:
    """Share of each segment inside the union of all boxes, by merging intervals along it."""
    segs, boxes = sj.boxed_segments(layer(spark, d, "v_segs")), layer(spark, d, "v_boxes")
    frac = overlay.union_share(overlay.merged_intervals(segs, boxes, overlay.box_clips, 1000.0), "id")
    out = segs.select("id").join(frac, "id", "left").withColumn("frac", F.coalesce("share", F.lit(0.0)))
    return out.select("id", F.round("frac", 6).alias("frac"), (F.col("frac") >= 0.5).cast("int").alias("label"))


@query(
    with_layers("v_segs", "v_boxes")
    + f""", iv as (select s.id, {_LO.replace("t.", "b.")} as lo, {_HI.replace("t.", "b.")} as hi from v_segs s join v_boxes b on least(s.x1, s.x2) <= b.maxx and greatest(s.x1, s.x2) >= b.minx and least(s.y1, s.y2) <= b.maxy and greatest(s.y1, s.y2) >= b.miny),
    ok as (select * from iv where lo < hi),
    m as (select id, lo, hi, max(hi) over (partition by id order by lo, hi rows between unbounded preceding and 1 preceding) as before from ok),
    f as (select id, sum(greatest(0, hi - greatest(lo, coalesce(before, 0)))) as frac from m group by id),
    e as (select id, lo as a, hi as b from ok union all select id, 1.0, 1.0 from v_segs),
    gap as (select id, greatest(0.0, coalesce(max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding), 0.0)) as lo, a as hi from e)
    select gap.id, round(lo, 6) as lo, round(hi, 6) as hi from gap left join f using (id) where hi > lo and coalesce(frac, 0) <= 0.5"""
)
def cut_by_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the segments outside all boxes; segments that lose more than half go altogether, as do those wholly covered."""
    segs, boxes = sj.boxed_segments(layer(spark, d, "v_segs").select("id", "x1", "y1", "x2", "y2")), layer(spark, d, "v_boxes")
    left, covered = overlay.open_intervals(segs, boxes, coverage.box_cover(boxes, 10.0), overlay.box_clips, 1000.0)
    parts = overlay.cut_outside(left, covered, "id", most_removed=0.5)
    return parts.select("id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_NEAR300 = "sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 300"
_COMP300 = f"nb as (select p.id as u, s.id as v from v_pts p join v_pts s on {_NEAR300}), reach(u, v) as (select id, id from v_pts union select r.u, nb.v from reach r join nb on r.v = nb.u), comp as (select u, min(v) as c from reach group by u)"


@query(with_layers("v_pts") + f", {_COMP300} select c as id, count(*) as members from comp group by c")
def distance_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Single-linkage groups of points at most 300 m apart; the lowest id of each stays."""
    return clustering.dedup_within(layer(spark, d, "v_pts"), 300.0).select("id", "members")


_DB_PAIRS = "pr as (select p.id as u, s.id as v from v_bldg p join v_bldg s on floor(p.x / 60) between floor(s.x / 60) - 1 and floor(s.x / 60) + 1 and floor(p.y / 60) between floor(s.y / 60) - 1 and floor(s.y / 60) + 1 where sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 60)"
_DB_SQL = f"""{_DB_PAIRS}, core as (select u from pr group by u having count(*) >= 3),
cc as (select u, v from pr where u in (select u from core) and v in (select u from core)),
reach(u, v) as (select u, u from core union select r.u, cc.v from reach r join cc on r.v = cc.u),
lab as (select u, min(v) as c from reach group by u),
border as (select pr.u, min(lab.c) as c from pr join lab on pr.v = lab.u where pr.u not in (select u from core) group by pr.u),
labels as (select u as id, c from lab union all select u, c from border)"""


@query(with_layers("v_bldg") + f", {_DB_SQL} select b.id, coalesce(c, -1) as cluster from v_bldg b left join labels l on b.id = l.id")
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    """DBSCAN with radius 60 m and three neighbours, itself included; -1 is noise."""
    return clustering.dbscan(layer(spark, d, "v_bldg"), 60.0, 3).select("id", "cluster")


@query(
    with_layers("v_bldg")
    + f""", {_DB_SQL}, j as (select b.id, b.x, b.y, b.sqft, coalesce(c, -1) as c from v_bldg b left join labels l on b.id = l.id),
    g as (select 'cluster' as category, c, sum(sqft) as size_sqft, count(*) as n, arg_max(x, sqft) as x, arg_max(y, sqft) as y from j where c >= 0 group by c having max(sqft) >= 300000)
    select category, round(size_sqft, 2) as size_sqft, n, x, y from g union all select 'mega_structure', round(sqft, 2), 1, x, y from j where c = -1 and sqft >= 450000"""
)
def building_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A point at the largest building of each cluster with a large one, and single very large buildings."""
    out = clustering.building_clusters(layer(spark, d, "v_bldg"), 60.0, 3, large=300000.0, mega=450000.0)
    return out.select("category", F.round("size_sqft", 2).alias("size_sqft"), "n", "x", "y")


@query(
    with_layers("v_sites", "v_bldg")
    + """, p as (select s.id, b.sqft from v_sites s join v_bldg b on sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) <= 250)
    select s.id, count(p.sqft) as n, round(coalesce(median(sqft), 0), 4) as med, round(coalesce(stddev_samp(sqft), 0), 4) as std, round(coalesce(sum(sqft), 0), 2) as total from v_sites s left join p using (id) group by s.id"""
)
def building_stats_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Count, median, spread and total of the buildings within 250 m; zeros where there are none."""
    sites = _sites(spark, d)
    pairs = sj.within_distance(sites, sj.boxed_points(layer(spark, d, "v_bldg")), 250.0, sj.point_distance())
    stats = agg.size_stats(pairs, "l_id", "r_sqft")
    out = sites.select("id").join(stats.withColumnRenamed("l_id", "id"), "id", "left").na.fill(0)
    return out.select("id", "n", F.round("med", 4).alias("med"), F.round("std", 4).alias("std"), F.round("total", 2).alias("total"))


@query(
    with_layers("v_pts", "v_boxes")
    + f""", p as (select p.id, b.val, b.h * b.h * 4 as area from v_pts p join v_boxes b on {_IN_BOX})
    select id, round(sum(val * area) / nullif(sum(case when val is not null then area end), 0), 4) as mean_val from p group by id"""
)
def parcel_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted mean value of the parcels around a point; parcels without value don't weigh."""
    pairs = _points_in_boxes(spark, d).withColumn("area", F.col("r_h") * F.col("r_h") * 4)
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.round(agg.weighted_mean("r_val", "area"), 4).alias("mean_val"))


@query(
    with_layers("v_pts", "v_sites")
    + f""", m as (select s.id as site_id, p.cls, count(*) as n from v_pts p join v_sites s on {_D} <= 1500 group by 1, 2),
    t as (select site_id, sum(n) as total from m group by site_id),
    e as (select m.site_id, round(-sum(n / total * log2(n / total)), 4) as entropy from m join t using (site_id) group by m.site_id),
    b as (select site_id, cls, row_number() over (partition by site_id order by n desc, cls) as k from m)
    select site_id, cls as dominant, entropy + 0 as entropy from b join e using (site_id) where k = 1"""
)
def dominant_class_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Most common class within 1.5 km of each site, the smallest of tied ones, and the classes' entropy in bits."""
    pairs = sj.within_distance(_pts(spark, d), _sites(spark, d), 1500.0, sj.point_distance())
    return agg.mode_and_entropy(pairs.select(F.col("r_id").alias("site_id"), F.col("l_cls").alias("cls")), "site_id", "cls", "dominant")


@query(
    with_layers("v_sites", "v_pts", "v_bldg", "v_boxes")
    + f""", a as (select s.id, count(p.id) as n from v_sites s left join v_pts p on {_D} <= 1000 group by s.id),
    b as (select s.id, count(p.id) as n from v_sites s left join v_bldg p on {_D} <= 500 group by s.id),
    c as (select s.id, count(p.id) as n from v_sites s left join v_boxes p on s.x between p.minx and p.maxx and s.y between p.miny and p.maxy group by s.id)
    select a.id, cast(a.n + b.n + c.n as bigint) as composite, case when c.n >= 1 then 'industrial' when a.n > 0 then 'substation' when b.n > 0 then 'solar' else 'residential' end as cls from a join b using (id) join c using (id)"""
)
def composite_count_class(spark: SparkSession, d: str) -> DataFrame:
    """Counts over several layers added up, and the class by ordered rules."""
    sites = _sites(spark, d)
    out = sites.select("id")
    parts = {
        "a": sj.within_distance(sites, _pts(spark, d), 1000.0, sj.point_distance()),
        "b": sj.within_distance(sites, sj.boxed_points(layer(spark, d, "v_bldg")), 500.0, sj.point_distance()),
        "c": sj.box_pairs(sites, layer(spark, d, "v_boxes"), 200.0),
    }
    for name, pairs in parts.items():
        out = sj.count_matches(out, "id", pairs, name)
    cls = agg.point_class(F.col("c"), F.col("a") > 0, F.col("b") > 0)
    return out.select("id", (F.col("a") + F.col("b") + F.col("c")).alias("composite"), cls.alias("cls"))


@query(
    with_layers("v_pts", "v_lines")
    + f", near as (select p.id, s.id as line_id, s.nation, row_number() over (partition by p.id order by s.nation, s.id) as k from v_pts p join v_lines s on {_PL} <= 400) select p.id, coalesce(near.nation, 0) as nation from v_pts p left join near on p.id = near.id and k = 1"
)
def first_hit_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The first region, in a declared order, whose line lies within 400 m; region 0 where there is none."""
    pts = _pts(spark, d)
    pairs = sj.within_distance(pts, sj.boxed_segments(layer(spark, d, "v_lines")), 400.0, sj.point_line_distance())
    first = sj.first_match(pairs, [F.col("r_nation"), F.col("r_id")], "id").select(F.col("l_id").alias("id"), F.col("r_nation").alias("nation"))
    return pts.select("id").join(first, "id", "left").select("id", F.coalesce("nation", F.lit(0)).alias("nation"))


@query(with_layers("v_sites") + ", n as (select * from v_sites) select a.id as a_id, b.id as b_id, a.nation, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) as dist from n a join n b on a.nation = b.nation and a.id < b.id")
def pairs_within_group(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sites of one nation with their distance."""
    sites = layer(spark, d, "v_sites")
    a, b = sj.prefixed(sites, "l_"), sj.prefixed(sites, "r_")
    pairs = a.join(b, (F.col("l_nation") == F.col("r_nation")) & (F.col("l_id") < F.col("r_id")))
    return pairs.select(F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id"), F.col("l_nation").alias("nation"), F.round(sj.point_distance(), 4).alias("dist"))


@query(with_layers("v_pts", "v_sites") + f", r as (select p.id, s.id as site_id, {_D} as d, row_number() over (partition by p.id order by {_D}, s.id) as k from v_pts p join v_sites s on p.nation = s.nation where {_D} <= 4000) select id, site_id, round(d, 4) as dist from r where k = 1")
def nearest_in_same_group(spark: SparkSession, d: str) -> DataFrame:
    """The nearest site of the same nation within 4 km."""
    pts, sites = sj.prefixed(layer(spark, d, "v_pts"), "l_"), sj.prefixed(layer(spark, d, "v_sites"), "r_")
    pairs = pts.join(sites, F.col("l_nation") == F.col("r_nation")).withColumn("dist", sj.point_distance()).where("dist <= 4000")
    best = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("dist", "r_id")).alias("b"))
    return best.select("id", F.col("b.r_id").alias("site_id"), F.round("b.dist", 4).alias("dist"))


_CROSS = """x as (select s.id, l.id as line_id, ((l.x1 - s.x1) * (l.y2 - l.y1) - (l.y1 - s.y1) * (l.x2 - l.x1)) / nullif((s.x2 - s.x1) * (l.y2 - l.y1) - (s.y2 - s.y1) * (l.x2 - l.x1), 0) as t,
((l.x1 - s.x1) * (s.y2 - s.y1) - (l.y1 - s.y1) * (s.x2 - s.x1)) / nullif((s.x2 - s.x1) * (l.y2 - l.y1) - (s.y2 - s.y1) * (l.x2 - l.x1), 0) as u, sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) as len from v_segs s, v_lines l)"""


@query(with_layers("v_segs", "v_lines") + f", {_CROSS}, h as (select id, line_id, t, (t - 1) * len as gap, row_number() over (partition by id order by t, line_id) as k from x where t > 1 and (t - 1) * len <= 300 and u between 0 and 1) select id, line_id, round(gap, 4) as gap from h where k = 1")
def extend_to_line(spark: SparkSession, d: str) -> DataFrame:
    """Where a segment, drawn on by up to 300 m beyond its end, first meets a line."""
    hits = overlay.extended_crossings(layer(spark, d, "v_segs"), layer(spark, d, "v_lines"), 300.0, cell=1000.0)
    return hits.select("id", F.col("other_id").alias("line_id"), F.round("gap", 4).alias("gap"))


@query(
    with_layers("v_pts", "v_bldg", "v_lines")
    + f""", near as (select distinct p.id from v_pts p join v_bldg b on sqrt({_BD}) <= 200 union select p.id from v_pts p join v_lines s on {_PL} <= 300)
    select p.id, case when near.id is not null then 'high_res' else 'low_res' end as type from v_pts p left join near on p.id = near.id"""
)
def zone_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Points near buildings or lines are high resolution, all others low."""
    pts = _pts(spark, d)
    a = sj.within_distance(pts, sj.boxed_points(layer(spark, d, "v_bldg")), 200.0, sj.point_distance()).select("l_id")
    b = sj.within_distance(pts, sj.boxed_segments(layer(spark, d, "v_lines")), 300.0, sj.point_line_distance()).select("l_id")
    near = a.union(b).distinct().withColumn("near", F.lit(True))
    return pts.join(near, F.col("id") == F.col("l_id"), "left").select("id", F.when(F.col("near"), "high_res").otherwise("low_res").alias("type"))


@query(
    with_layers("v_sites", "v_boxes")
    + """, b as (select id, cx, cy, h from v_boxes), pr as (select x.id as u, y.id as v from b x join b y on greatest(abs(x.cx - y.cx) - x.h - y.h, 0) <= 65 and greatest(abs(x.cy - y.cy) - x.h - y.h, 0) <= 65 and sqrt(power(greatest(abs(x.cx - y.cx) - x.h - y.h, 0), 2) + power(greatest(abs(x.cy - y.cy) - x.h - y.h, 0), 2)) <= 65),
    reach(u, v) as (select id, id from b union select r.u, pr.v from reach r join pr on r.v = pr.u), comp as (select u, min(v) as c from reach group by u)
    select c as id, count(*) as n, round(avg(w.val), 6) as mean_val, min(w.minx) as minx, max(w.maxx) as maxx from comp join v_boxes w on comp.u = w.id group by c"""
)
def merge_polygons_within(spark: SparkSession, d: str) -> DataFrame:
    """Boxes at most 65 m apart merge: least id, count, mean of values, common envelope."""
    merged = clustering.merge_boxes_within(layer(spark, d, "v_boxes"), 65.0)
    return merged.select("id", "n", F.round("mean_val", 6).alias("mean_val"), "minx", "maxx")


@query(
    with_layers("v_segs")
    + """, l as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len, sqrt(price) as bend from v_segs)
    select id, round(sum(len) over (partition by name_id), 3) as name_total_m, round(sum(len * bend) over (partition by name_id) / nullif(sum(len) over (partition by name_id), 0), 4) as name_mean from l"""
)
def per_name_stats(spark: SparkSession, d: str) -> DataFrame:
    """Length and length-weighted mean over all segments of a name, given back to each segment."""
    segs = layer(spark, d, "v_segs").withColumns({"len": g.segment_length(), "bend": F.sqrt("price")})
    w = Window.partitionBy("name_id")
    mean = F.sum(F.col("len") * F.col("bend")).over(w) / F.nullif(F.sum("len").over(w), F.lit(0.0))
    return segs.select("id", F.round(F.sum("len").over(w), 3).alias("name_total_m"), F.round(mean, 4).alias("name_mean"))
