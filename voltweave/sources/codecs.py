"""Geometry encodings: WKB, WKT and GeoJSON to and from the engine's struct, in Arrow functions.

The struct is kind and parts: parts of rings of points; a line is a part with one open ring, a point a part with one ring of
one point. Encodings that can't be read give null.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

GEOMETRY = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
CODES = {v: k for k, v in KINDS.items()}
Geometry = dict


def _points(xy) -> list[dict]:
    return [{"x": float(p[0]), "y": float(p[1])} for p in xy]


def from_coordinates(kind: str, c) -> Geometry:
    """From GeoJSON's nesting."""
    if kind == "Point":
        parts = [[_points([c])]] if c else []
    elif kind in ("LineString", "MultiPoint"):
        parts = [[_points(c)]] if kind == "LineString" else [[_points([p])] for p in c]
    elif kind in ("Polygon", "MultiLineString"):
        parts = [[_points(r) for r in c]] if kind == "Polygon" else [[_points(r)] for r in c]
    elif kind == "MultiPolygon":
        parts = [[_points(r) for r in p] for p in c]
    else:
        raise ValueError(kind)
    return {"kind": kind, "parts": parts}


def to_coordinates(g: Geometry):
    flat = [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in g["parts"]]
    kind = g["kind"]
    if kind == "Point":
        return flat[0][0][0] if flat else []
    if kind == "LineString":
        return flat[0][0] if flat else []
    if kind == "Polygon":
        return flat[0] if flat else []
    if kind == "MultiPoint":
        return [part[0][0] for part in flat]
    return [part[0] for part in flat] if kind == "MultiLineString" else flat


def read_wkb(data: bytes) -> Geometry:
    """Both byte orders; Z and M values and an EWKB SRID are passed over."""
    at = 0

    def geometry() -> Geometry:
        nonlocal at
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        code %= 1000
        size = 8 * (2 + extra)

        def point() -> tuple[float, float]:
            nonlocal at
            out = struct.unpack_from(order + "dd", data, at)
            at += size
            return out

        def many(f: Callable) -> list:
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return [f() for _ in range(n)]

        kind = KINDS[code]
        if code == 1:
            p = point()
            return from_coordinates(kind, p if p[0] == p[0] else None)
        if code == 2:
            return from_coordinates(kind, many(point))
        if code == 3:
            return from_coordinates(kind, many(lambda: many(point)))
        return {"kind": kind, "parts": [part for g in many(geometry) for part in g["parts"]]}

    return geometry()


def write_wkb(g: Geometry) -> bytes:
    """Little-endian, two dimensions."""
    c = to_coordinates(g)
    head = lambda kind: struct.pack("<BI", 1, CODES[kind])
    run = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    rings = lambda rs: struct.pack("<I", len(rs)) + b"".join(map(run, rs))
    kind = g["kind"]
    if kind == "Point":
        return head(kind) + struct.pack("<dd", *(c if len(c) else (float("nan"),) * 2))
    if kind == "LineString":
        return head(kind) + run(c)
    if kind == "Polygon":
        return head(kind) + rings(c)
    one = {"MultiPoint": lambda p: head("Point") + struct.pack("<dd", *p), "MultiLineString": lambda line: head("LineString") + run(line), "MultiPolygon": lambda p: head("Polygon") + rings(p)}[kind]
    return head(kind) + struct.pack("<I", len(c)) + b"".join(map(one, c))


def read_wkt(text: str) -> Geometry:
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(EMPTY|\(.*\))\s*", text, re.DOTALL)
    if not m:
        raise ValueError("WKT")
    kind = next(k for k in CODES if k.upper() == m[1].upper())
    if m[2] == "EMPTY":
        return {"kind": kind, "parts": []}
    body = re.sub(r"([^(),]+)", lambda p: "[" + ",".join(p[1].split()) + "]" if p[1].strip() else "", m[2])
    nested = json.loads(body.replace("(", "[").replace(")", "]"))
    if kind == "Point":
        nested = nested[0]
    elif kind == "MultiPoint":
        nested = [p[0] if isinstance(p[0], list) else p for p in nested]
    return from_coordinates(kind, nested)


def write_wkt(g: Geometry) -> str:
    if not g["parts"]:
        return f"{g['kind'].upper()} EMPTY"
    number = lambda v: repr(v).removesuffix(".0")

    def text(c) -> str:
        return f"{number(c[0])} {number(c[1])}" if isinstance(c, tuple) else "(" + ", ".join(map(text, c)) + ")"

    c = to_coordinates(g)
    return f"{g['kind'].upper()} " + (f"({text(c)})" if isinstance(c, tuple) else text(c))


def read_geojson(text: str) -> Geometry:
    x = json.loads(text)
    x = x.get("geometry", x) if x.get("type") == "Feature" else x
    return from_coordinates(x["type"], x["coordinates"])


def write_geojson(g: Geometry) -> str:
    return json.dumps({"type": g["kind"], "coordinates": to_coordinates(g)})


def _decoder(read: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf(GEOMETRY)
    def decode(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append(read(v) if v is not None else None)
            except (ValueError, KeyError, IndexError, StopIteration, struct.error, TypeError):
                out.append(None)
        return pd.DataFrame({"kind": [g and g["kind"] for g in out], "parts": [g and g["parts"] for g in out]}, dtype=object)

    return lambda c: F.transform(F.array(decode(c)), lambda g: F.when(g["kind"].isNotNull(), g))[0]


def _encoder(write: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def encode(g: pd.DataFrame) -> pd.Series:
        return pd.Series([write({"kind": k, "parts": p}) if k is not None else None for k, p in zip(g["kind"], g["parts"], strict=True)], dtype=object)

    return encode


def wkb_to_geometry(c: Column) -> Column:
    return _decoder(lambda v: read_wkb(bytes(v)))(c)


def wkt_to_geometry(c: Column) -> Column:
    return _decoder(read_wkt)(c)


def geojson_to_geometry(c: Column) -> Column:
    return _decoder(read_geojson)(c)


def geometry_to_wkb(c: Column) -> Column:
    return _encoder(write_wkb, "binary")(c)


def geometry_to_wkt(c: Column) -> Column:
    return _encoder(write_wkt, "string")(c)


def geometry_to_geojson(c: Column) -> Column:
    return _encoder(write_geojson, "string")(c)


def geometry_column(df: DataFrame, names: tuple[str, ...] = ("geometry", "geom", "shape")) -> DataFrame:
    """df with its geometry column decoded into `geom_`: the first of the usual names, by its type WKB or text.

    Text is GeoJSON where it starts with a brace, else WKT.
    """
    found = next((c for n in names for c in df.columns if c.lower() == n), None)
    if found is None:
        raise ValueError("no geometry column")
    kind = df.schema[found].dataType
    c = F.col(found)
    if isinstance(kind, BinaryType):
        return df.withColumn("geom_", wkb_to_geometry(c))
    if isinstance(kind, StringType):
        return df.withColumn("geom_", _decoder(lambda v: read_geojson(v) if v.lstrip().startswith("{") else read_wkt(v))(c))
    return df.withColumn("geom_", c)


def exploded_parts(df: DataFrame, geometry: str = "geom_") -> DataFrame:
    """One row per part, with its number in `part_`."""
    single = F.regexp_replace(F.col(geometry)["kind"], "^Multi", "")
    out = df.select(*[c for c in df.columns if c != geometry], single.alias("_k"), F.posexplode(F.col(geometry)["parts"]).alias("part_", "_p"))
    return out.withColumn(geometry, F.struct(F.col("_k").alias("kind"), F.array("_p").alias("parts"))).drop("_k", "_p")
