"""Queries of the attribute functions and set operations, on strings built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.functions import scalar as s
from voltweave.plans import boundaries
from voltweave.plans.registry import query

_VOLT = "case p_partkey % 6 when 0 then null when 1 then '' when 2 then '69000' when 3 then '13800;69000' when 4 then 'low; ' || cast(p_size as varchar) || '000' else cast(p_size as varchar) || '000; 115000;69kV' end"


def _volts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", "cast(p_size as double) as min_volt", f"{_VOLT.replace('varchar', 'string')} as voltage")


@query(f"with v as (select p_partkey as id, cast(p_size as double) as min_volt, {_VOLT} as voltage from part), t as (select *, list_max(list_transform(list_filter(list_transform(string_split(voltage, ';'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9.]+')), lambda x: try_cast(x as double))) / 1000.0::double as top from v) select id, coalesce(try_cast(trim(string_split(voltage, ';')[1]) as double) < 69000, true) as keep, coalesce(case when top > 0 then top end, case when min_volt > 0 then min_volt end) as voltage_kv from t")
def voltage_parse(spark: SparkSession, d: str) -> DataFrame:
    """Which lines count as distribution, and voltages in kV from lists of tokens."""
    return _volts(spark, d).select("id", s.keep_voltage("voltage").alias("keep"), s.voltage_kv("voltage", "min_volt").alias("voltage_kv"))


_UTIL = "case p_partkey % 4 when 0 then null when 1 then 'Joint ' || p_brand || ' / National  Grid/ ' when 2 then p_type || '/' || p_brand || '/' || p_type else '- ' || p_brand || ';' end"


@query(f"with u as (select p_partkey as id, {_UTIL} as name from part), e as (select distinct id, trim(regexp_replace(x, '\\s+', ' ', 'g'), ' -;,') as utility from (select id, unnest(string_split(regexp_replace(upper(name), '\\bJOINT\\b', ' ', 'g'), '/')) as x from u)) select id, utility from e where utility <> ''")
def utility_parse_explode(spark: SparkSession, d: str) -> DataFrame:
    """The utilities named in a slash-separated list, one row each."""
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{_UTIL} as name")
    return rows.select("id", F.explode(s.utilities("name")).alias("utility"))


@query("select event_id from events where event_type in ('purchase', 'error') or json_extract_string(props, '$.k') = '87'")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events that match any of several tag conditions, over a map of tags."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"))
    return rows.where(s.tags_match("tags", {"type": ["purchase", "error"], "k": "87"})).select("event_id")


_HW = "case p_partkey % 9 when 0 then null when 1 then 'motorway_link' when 2 then 'trunk' when 3 then 'primary_link' when 4 then 'tertiary_link' when 5 then 'unclassified' when 6 then 'residential' when 7 then '[''Primary'', ''x'']' else 'motorway' end"


@query(
    f"""with h as (select p_partkey as id, {_HW} as highway from part), c as (select *, string_split(regexp_replace(lower(trim(coalesce(highway, ''))), '[\\[\\] '']', '', 'g'), ',')[1] as first from h)
    select id, case when highway = 'motorway_link' then 'highway_link' when highway in ('primary_link', 'trunk_link') then highway when ends_with(highway, '_link') then 'generic_link' end as link,
    case when coalesce(highway, '') in ('motorway', 'motorway_link') then null when coalesce(highway, '') in ('', 'unclassified') then 'service' when highway in ('trunk', 'trunk_link', 'primary_link') then 'primary' else highway end as normal,
    case when first in ('primary', 'secondary', 'tertiary', 'residential', 'service', 'osm_grid') then first else 'other' end as cls from c"""
)
def highway_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{_HW} as highway".replace("''", "\\'"))
    return rows.select("id", s.link_category("highway").alias("link"), s.normal_highway("highway").alias("normal"), s.highway_class("highway").alias("cls"))


_MODES = ["RAIL", "SHIP", "AIR"]


@query("select o_orderkey as id, " + ", ".join(f"cast(cls = '{c}' as integer) as prio_{c}" for c in ("urgent", "high", "other")) + " from (select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' when o_orderpriority = '2-HIGH' then 'high' else 'other' end as cls from orders)")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    """One column per class of a fixed list."""
    cls = F.regexp_extract(F.lower("o_orderpriority"), r"^\d-(\w+)$", 1)
    known = s.highway_class(cls, ["urgent", "high"])
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), *s.one_hot(known, ["urgent", "high", "other"], "prio_"))


@query("select n_nationkey as id, case when n_nationkey % 2 = 0 and n_regionkey % 2 = 0 then 0 when n_nationkey % 2 = 0 then 1 when n_regionkey % 2 = 0 then 2 end as code, cast(contains(upper(n_name), 'AN') as integer) as named, case when n_nationkey * 7 - 40 >= 0 then 32600 else 32700 end + cast(floor((n_nationkey * 14.0 - 170 + 180) / 6) as integer) + 1 as epsg from nation")
def source_codes(spark: SparkSession, d: str) -> DataFrame:
    """Which sources know a row, a keyword flag, and the UTM zone of a place."""
    rows = spark.read.parquet(f"{d}/nation.parquet")
    lon, lat = F.col("n_nationkey") * 14.0 - 170, F.col("n_nationkey") * 7 - 40
    return rows.select(F.col("n_nationkey").alias("id"), s.source_code(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey") % 2 == 0).alias("code"), s.mentions("n_name", "an").alias("named"), s.utm_epsg(lon, lat).alias("epsg"))


@query("select max('ST_Deliverable' || strftime(o_orderdate, '%Y%m%d') || '.zip') as latest from orders")
def latest_deliverable(spark: SparkSession, d: str) -> DataFrame:
    """The delivery with the latest date in its name."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("ST_Deliverable"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".zip")).alias("path"))
    return rows.agg(F.max_by("path", s.deliverable_date("path")).alias("latest"))


@query("select 'customer' as source, c_custkey as id, c_acctbal as amount, cast(null as varchar) as note from customer union all select 'supplier', s_suppkey, null, s_name from supplier")
def merge_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Layers with different columns, aligned by name and filled with nulls."""
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    b = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select l_partkey as id, 'both' as side from (select l_partkey from lineitem intersect select p_partkey from part where p_size > 25) union all select p_partkey, 'unsold' from (select p_partkey from part except select l_partkey from lineitem)")
def key_set_operations(spark: SparkSession, d: str) -> DataFrame:
    sold = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("id"))
    parts = spark.read.parquet(f"{d}/part.parquet")
    both = sold.intersect(parts.where("p_size > 25").select(F.col("p_partkey").alias("id"))).withColumn("side", F.lit("both"))
    return both.unionByName(parts.select(F.col("p_partkey").alias("id")).subtract(sold).withColumn("side", F.lit("unsold")))


@query("select n_nationkey, n_regionkey from nation where lower(trim(n_name)) = 'nation_7'")
def boundary_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a layer that a name picks, case aside."""
    nations = spark.read.parquet(f"{d}/nation.parquet").withColumnRenamed("n_name", "name")
    return boundaries.named_rows(nations, " Nation_7 ").select("n_nationkey", "n_regionkey")
