"""Attribute functions: voltages, classes, names, tags, safe casts and arithmetic. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltweave.functions.geometry import col

MAX_DISTRIBUTION_VOLTS = 69000.0


def keep_voltage(v: Column | str) -> Column:
    """True for lines below 69 kV by their first `;` token, and for missing, blank or unreadable voltages."""
    first = F.trim(F.get(F.split(col(v), ";"), F.lit(0)))
    return F.coalesce(first.try_cast("double") < MAX_DISTRIBUTION_VOLTS, F.lit(True))


def voltage_kv(v: Column | str, least: Column | str) -> Column:
    """Largest numeric `;` token over 1000 if above 0, else the minimum voltage if above 0, else null."""
    tokens = F.filter(F.transform(F.split(col(v), ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9.]+$"))
    top = F.array_max(F.transform(tokens, lambda x: x.try_cast("double"))) / 1000.0
    least = col(least).cast("double")
    return F.coalesce(F.when(top > 0, top), F.when(least > 0, least))


def source_code(first: Column, second: Column) -> Column:
    """0 if both sources have it, 1 for the first only, 2 for the second only, else null."""
    return F.when(first & second, 0).when(first, 1).when(second, 2)


def mentions(text: Column | str, keyword: str) -> Column:
    return F.coalesce(F.contains(F.upper(col(text)), F.lit(keyword.upper())), F.lit(False)).cast("int")


def link_category(highway: Column | str) -> Column:
    """Class of a link road; null for others."""
    h = col(highway)
    return F.when(h == "motorway_link", "highway_link").when(h.isin("primary_link", "trunk_link"), h).when(F.endswith(h, F.lit("_link")), "generic_link")


def normal_highway(highway: Column | str) -> Column:
    """The network's road classes; motorways (null here) don't belong to it."""
    h = F.trim(F.coalesce(col(highway), F.lit("")))
    out = F.when(h.isin("motorway", "motorway_link"), F.lit(None).cast("string")).when(h.isin("", "unclassified"), "service")
    return out.when(h.isin("trunk", "trunk_link", "primary_link"), "primary").otherwise(h)


def utilities(names: Column | str) -> Column:
    """Sorted distinct utilities of a slash-separated name: upper case, single blanks, without the word JOINT."""
    text = F.regexp_replace(F.upper(F.coalesce(col(names), F.lit(""))), r"\bJOINT\b", " ")
    parts = F.transform(F.split(text, "/"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" -;,")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def tags_match(tags: Column | str, wanted: dict[str, list[str] | str | bool]) -> Column:
    """Whether any key matches: True asks for its presence, a string for equality, a list for membership."""
    tags = col(tags)
    out = F.lit(False)
    for key, value in wanted.items():
        have = F.try_element_at(tags, F.lit(key))
        if value is True:
            out = out | have.isNotNull()
        else:
            out = out | F.coalesce(have.isin(*([value] if isinstance(value, str) else value)), F.lit(False))
    return out


def number(text: Column | str) -> Column:
    """A double, null where the text is none, or not finite."""
    return finite(F.trim(col(text).cast("string")).try_cast("double"))


def finite(x: Column | str) -> Column:
    """null for NaN and the infinities."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def share(part: Column, whole: Column, least: float = 1e-9) -> Column:
    """A division that never meets zero."""
    return part / F.greatest(whole, F.lit(least))


def joined_text(*columns: str) -> Column:
    """The non-null texts joined by blanks, null if that leaves nothing."""
    return F.nullif(F.trim(F.concat_ws(" ", *columns)), F.lit(""))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(text))), r"\s+", "-")


def utm_epsg(lon: Column | str, lat: Column | str) -> Column:
    """Code of the UTM zone of a place: 326xx north, 327xx south."""
    zone = F.floor((col(lon) + 180) / 6).cast("int") + 1
    return F.when(col(lat) >= 0, 32600 + zone).otherwise(32700 + zone)


def deliverable_date(path: Column | str) -> Column:
    """The date in a delivery's name, as eight digits, null without one."""
    return F.nullif(F.regexp_extract(col(path), r"Deliverable(\d{8})", 1), F.lit(""))


def tile_size(folder: Column | str, default: int = 500) -> Column:
    found = F.nullif(F.regexp_extract(col(folder), r"^(\d+)_tiles$", 1), F.lit(""))
    return F.coalesce(found.cast("int"), F.lit(default))


#: Road classes of the one-hot columns (fixed values).
HIGHWAYS = ["primary", "secondary", "tertiary", "residential", "service", "osm_grid", "other"]


def highway_class(highway: Column | str, known: list[str] | None = None) -> Column:
    """The first of a possibly bracketed list, in lower case; unknown and missing ones are `other`."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col(highway), F.lit("")))), r"[\[\] ']", "")
    first = F.get(F.split(text, ","), F.lit(0))
    return F.when(first.isin(*(known or HIGHWAYS)), first).otherwise("other")


def one_hot(cls: Column, names: list[str], prefix: str) -> list[Column]:
    return [(cls == n).cast("int").alias(f"{prefix}{n}") for n in names]
