"""Canonical layers as data: which sources, which filters, which clean-up. One interpreter turns a recipe into a plan.

A source is a DataFrame with source-specific columns and x, y (points), or minx to maxy and whatever measures the filters name. Missing
sources are left out; a layer without any source is None. Rows are numbered by source order, so deduplication prefers the earlier
source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.functions import scalar
from voltweave.operators import clustering, sampling
from voltweave.operators import spatial_join as sj

DEDUP_M = 50.0


@dataclass(frozen=True)
class Recipe:
    sources: tuple[str, ...]
    category: str
    where: str | None = None
    dedup: float | None = DEDUP_M
    near: tuple[str, float] | None = None  #: keep rows within so many metres of another layer
    kinds: tuple[str, ...] = ()  #: geometry kinds to keep


#: Thresholds in metres, square metres and feet (fixed values).
RECIPES: dict[str, Recipe] = {
    "solar_merged": Recipe(("osm_solar", "solar", "solar_uspvdb"), "GENERATORS", "area >= 100", None, kinds=("Polygon", "MultiPolygon")),
    "wind_merged": Recipe(("wind",), "GENERATORS"),
    "eia_gas_hydro": Recipe(("eia_gas", "eia_hydro"), "GENERATORS"),
    "bess_charging_stations": Recipe(("eia_bess", "alt_fuel"), "GENERATORS"),
    "substations_final": Recipe(("osm_substation", "hifld_substation"), "SUBSTATIONS", near=("roads", 200.0)),
    "transmission_lines": Recipe(("transmission",), "GRID", dedup=None),
    "osm_distribution_lines": Recipe(("osm_lines",), "GRID", "keep_voltage", None),
    "oil_gas_chemical": Recipe(("osm_wells", "osm_processing", "osm_transport", "fracfocus", "ethanol_gas", "compressor"), "INDUSTRY", "not coalesce(man_made = 'storage_tank' and coalesce(content, '') in ('', 'water'), false)"),
    "industry": Recipe(("osm_industry", "osm_industry_more", "intermodal"), "INDUSTRY"),
    "works": Recipe(("osm_works",), "INDUSTRY"),
    "mining_final": Recipe(("osm_mining", "mines", "quarries", "coal", "minerals"), "MINING"),
    "utilities_merged": Recipe(("osm_utilities", "wastewater"), "UTILITIES"),
    "ag_farms_merged": Recipe(("osm_food", "osm_farm", "mpi"), "AGRICULTURE", "not coalesce(building = 'greenhouse' and area < 500, false)"),
    "tunnels_major": Recipe(("osm_tunnels",), "TRANSPORT", "length >= 500", None),
    "bridges_lines": Recipe(("osm_bridges",), "TRANSPORT", "length >= 50", None, kinds=("LineString", "MultiLineString")),
    "rail_network": Recipe(("rail",), "TRANSPORT", dedup=None),
    "dams_major": Recipe(("dams",), "TRANSPORT", "dam_length >= 150"),
    "airports": Recipe(("osm_airports",), "TRANSPORT", dedup=None, kinds=("Polygon", "MultiPolygon")),
    "parkings": Recipe(("osm_parkings",), "TRANSPORT", dedup=None, kinds=("Polygon", "MultiPolygon")),
    "cemeteries": Recipe(("osm_cemeteries",), "PUBLIC", dedup=None, kinds=("Polygon", "MultiPolygon")),
    "towers_major": Recipe(("asr", "microwave", "service"), "TELECOM"),
    "towers_minor": Recipe(("osm_towers",), "TELECOM"),
    "hospitality": Recipe(("hotels", "monasteries"), "PUBLIC", "category in ('Hotel', 'Monastery')"),
    "public_infra": Recipe(("aerialways", "hospitals", "prisons", "schools"), "PUBLIC"),
    "frs_primary_merged": Recipe(("frs_primary",), "FRS"),
    "frs_secondary_merged": Recipe(("frs_secondary",), "FRS"),
}


def merged(sources: list[DataFrame]) -> DataFrame | None:
    """All rows, columns aligned by name, with row_id by source and position."""
    out = None
    for i, df in enumerate(sources):
        df = df.withColumns({"_source": F.lit(i), "_place": F.monotonically_increasing_id()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return None if out is None else sampling.renumbered(out, [F.col("_source"), F.col("_place")], "id").drop("_source", "_place")


def build(name: str, sources: dict[str, DataFrame], layers: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """The layer's rows with an id, columns of all its sources, and source_file, the source's name."""
    r = RECIPES[name]
    out = merged([sources[s].withColumn("source_file", F.lit(s)) for s in r.sources if s in sources])
    if out is None:
        return None
    if r.kinds:
        out = out.where(F.col("kind").isin(*r.kinds))
    if r.where == "keep_voltage":
        out = out.where(scalar.keep_voltage("voltage"))
    elif r.where:
        known = [c for c in ("man_made", "content", "building", "area", "length", "dam_length", "category") if c in r.where and c not in out.columns]
        out = out.withColumns({c: F.lit(None).cast("string") for c in known}) if known else out
        out = out.where(r.where).drop(*known)
    if r.near and layers and r.near[0] in layers:
        other, reach = layers[r.near[0]], r.near[1]
        lines = "x1" in other.columns
        right = sj.boxed_segments(other) if lines else sj.boxed_points(other)
        hits = sj.within_distance(sj.boxed_points(out), right, reach, sj.point_line_distance() if lines else sj.point_distance())
        out = sj.with_match(out, "id", hits)
    return clustering.dedup_within(out, r.dedup).drop("members") if r.dedup else out


def enriched_substations(subs: DataFrame, lines: DataFrame, solar: DataFrame) -> DataFrame:
    """subs with crossing_transmission_line, trans_line_voltage, near_pv, pv_size, voltage_kv, source_dataset, naics_bulk_power.

    lines: segments with voltage_kv; solar: boxes with area. pv_size is the whole area of the fields within 200 m, not their shares.
    """
    boxed = sj.boxed_points(subs)
    line = sj.within_distance(boxed, sj.boxed_segments(lines), 100.0, sj.point_line_distance())
    first = sj.first_match(line, [F.col("dist"), F.col("r_id")], "id").select(F.col("l_id").alias("id"), F.lit(1).alias("crossing_transmission_line"), F.col("r_voltage_kv").alias("trans_line_voltage"))
    dx = F.greatest(F.col("r_minx") - F.col("l_x"), F.col("l_x") - F.col("r_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("r_miny") - F.col("l_y"), F.col("l_y") - F.col("r_maxy"), F.lit(0.0))
    fields = sj.within_distance(boxed, solar, 200.0, F.sqrt(dx * dx + dy * dy), 400.0)
    pv = fields.groupBy(F.col("l_id").alias("id")).agg(F.min("dist").alias("near_pv"), F.sum("r_area").alias("pv_size"))
    out = subs.join(first, "id", "left").join(pv, "id", "left").withColumn("crossing_transmission_line", F.coalesce("crossing_transmission_line", F.lit(0))).withColumn("pv_size", F.coalesce("pv_size", F.lit(0.0)))
    have = lambda c: F.col(c) if c in subs.columns else F.lit(None).cast("string")
    return out.withColumns({
        "voltage_kv": scalar.voltage_kv(have("voltage"), have("min_volt").try_cast("double")),
        "source_dataset": scalar.source_code(have("power").isNotNull(), have("hifld_id").isNotNull()),
        "naics_bulk_power": scalar.mentions(have("naics_desc"), "BULK POWER"),
    })
