"""Scans: Parquet and GeoParquet, GeoJSON, GeoPackage, zipped layers, GeoTIFF rasters, OSM extracts.

Single-file formats come through Spark's binaryFile reader, so any Hadoop file system serves, one file to a row; large collections
are many files. Missing sources are empty relations only where `missing_ok` says so.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voltweave.functions import scalar
from voltweave.sources import codecs

FEATURE = f"source_file string, row_id long, properties map<string,string>, geom_ {codecs.GEOMETRY}"


#: Bytes of files in one Arrow batch, unless one file has more.
FILE_BYTES = 32 << 20


def parquet_layer(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame | None:
    """A (Geo)Parquet layer with its geometry decoded."""
    try:
        return codecs.geometry_column(spark.read.parquet(path))
    except AnalysisException:
        if missing_ok:
            return None
        raise


def _files(spark: SparkSession, path: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"  # read when the plan runs; whole files go one by one beyond it
    if not 0 < int(spark.conf.get(key, None) or 0) <= FILE_BYTES:
        spark.conf.set(key, str(FILE_BYTES))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _rows(features: Iterator[tuple[dict, dict | None]], path: str) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    for n, (properties, geometry) in enumerate(features):
        held.append((path, n, {k: text(v) for k, v in properties.items()}, geometry))
        if len(held) == 2000:
            yield pd.DataFrame(held, columns=["source_file", "row_id", "properties", "geom_"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["source_file", "row_id", "properties", "geom_"])


def _decoded(read, value) -> dict | None:
    try:
        return read(value)
    except (ValueError, KeyError, IndexError, StopIteration, struct.error, TypeError):
        return None


def geojson_features(content: bytes) -> Iterator[tuple[dict, dict | None]]:
    """A FeatureCollection, or a feature per line (GeoJSONSeq)."""
    text = content.decode("utf-8", "replace").lstrip("\x1e \n\r\t")
    try:
        whole = json.loads(text)
        items = whole["features"] if whole.get("type") == "FeatureCollection" else [whole]
    except ValueError:
        items = [json.loads(x) for x in text.replace("\x1e", "").splitlines() if x.strip()]
    for x in items:
        yield x.get("properties") or {}, _decoded(lambda g: codecs.from_coordinates(g["type"], g["coordinates"]), x.get("geometry"))


def geopackage_features(content: bytes, table: str | None = None) -> Iterator[tuple[dict, dict | None]]:
    """The features of a GeoPackage's (first) layer; SQLite needs a file, which lives as long as the task reads it."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            layers = db.execute("select table_name, column_name from gpkg_geometry_columns order by rowid").fetchall()
            name, geometry = next((x for x in layers if table in (None, x[0])), (None, None))
            if name is None:
                return
            cursor = db.execute('select * from "{}"'.format(name.replace('"', '""')))
            columns = [c[0] for c in cursor.description]
            for row in cursor:
                x = dict(zip(columns, row, strict=True))
                blob = x.pop(geometry)
                yield {k: v for k, v in x.items() if not isinstance(v, bytes)}, _decoded(geopackage_geometry, blob)
        finally:
            db.close()


def geopackage_geometry(blob: bytes) -> dict:
    """The WKB after a GeoPackage header, whose flags tell the envelope's size."""
    if blob[:2] != b"GP":
        raise ValueError("GeoPackage header")
    return codecs.read_wkb(blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :])


def zipped_features(content: bytes) -> Iterator[tuple[dict, dict | None]]:
    """All members of the first format found in a zip: GeoJSONSeq, GeoJSON, GeoPackage, Parquet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist())
        for suffixes, read in (((".geojsonseq", ".geojsonl"), geojson_features), ((".geojson", ".json"), geojson_features), ((".gpkg",), geopackage_features), ((".parquet", ".geoparquet"), parquet_features)):
            found = [n for n in names if n.lower().endswith(suffixes)]
            if found:
                for n in found:
                    yield from read(z.read(n))
                return


def parquet_features(content: bytes) -> Iterator[tuple[dict, dict | None]]:
    import pyarrow.parquet as pq

    for batch in pq.ParquetFile(io.BytesIO(content)).iter_batches():
        for x in batch.to_pylist():
            key = next((k for k in x if k.lower() in ("geometry", "geom", "shape")), None)
            value = x.pop(key) if key else None
            geometry = _decoded(codecs.read_wkb if isinstance(value, bytes) else codecs.read_wkt, value) if value is not None else None
            yield x, geometry


READERS = {".geojson": geojson_features, ".json": geojson_features, ".geojsonl": geojson_features, ".geojsonseq": geojson_features, ".gpkg": geopackage_features, ".zip": zipped_features, ".parquet": parquet_features}


def features(spark: SparkSession, path: str) -> DataFrame:
    """source_file, row_id, properties, geom_ of all files under a path, each read by its suffix; others are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                read = READERS.get(os.path.splitext(name)[1].lower())
                if read:
                    yield from _rows(read(bytes(content)), name)

    return _files(spark, path).mapInPandas(run, FEATURE)


def columns_from(df: DataFrame, names: list[str]) -> DataFrame:
    """Some properties as columns, null where a feature has none."""
    return df.select("source_file", "row_id", "geom_", *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names])


# ---------------------------------------------------------------- rasters


def tiff_band(content: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """First band of a classic TIFF, in strips or tiles, plain or deflated: values, (x0, y0, res x, res y), and the missing value."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    magic, at = struct.unpack_from(order + "HI", content, 2)
    if magic != 42:
        raise ValueError("TIFF")
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
    tags: dict[int, tuple] = {}
    (n,) = struct.unpack_from(order + "H", content, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind not in sizes:
            continue
        form = f"{order}{count}s" if kind == 2 else order + sizes[kind] * count
        place = at + 2 + 12 * i + 8
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(order + "I", content, place)
        tags[tag] = struct.unpack_from(form, content, place)
    cols, rows = tags[256][0], tags[257][0]
    bands, bits, form = tags.get(277, (1,))[0], tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)).newbyteorder(order)
    packing = tags.get(259, (1,))[0]
    if packing not in (1, 8, 32946):
        raise ValueError(f"compression {packing}")
    predictor = tags.get(317, (1,))[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    planes = bands if tags.get(284, (1,))[0] == 1 else 1
    if 324 in tags:
        w, h, offsets, lengths = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        w, h, offsets, lengths = cols, tags.get(278, (rows,))[0], tags[273], tags[279]
    across = -(-cols // w)
    out = np.zeros((-(-rows // h) * h, across * w), kind.newbyteorder("="))
    for k in range(across * -(-rows // h)):
        data = content[offsets[k] : offsets[k] + lengths[k]]
        data = zlib.decompress(data) if packing != 1 else data
        block = np.frombuffer(data[: len(data) // (kind.itemsize * w * planes) * kind.itemsize * w * planes], kind).reshape(-1, w, planes)[:, :, 0]
        if predictor == 2:
            block = np.cumsum(block.astype(np.int64), axis=1).astype(kind.newbyteorder("="))
        r, c = k // across * h, k % across * w
        out[r : r + len(block), c : c + w] = block
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    missing = tags.get(42113)
    return out[:rows, :cols], (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]), float(missing[0].rstrip(b"\0 ")) if missing else None


PIXELS = "source_file string, row long, col long, v double, x0 double, y0 double, res double"


def raster_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The valid pixels of all GeoTIFFs (plain, or the first in a zip) under a path, rows counted down from y0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                content = bytes(content)
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = next((n for n in sorted(z.namelist()) if n.lower().endswith((".tif", ".tiff"))), None)
                        content = z.read(inner) if inner else b""
                elif not name.lower().endswith((".tif", ".tiff")):
                    continue
                if not content:
                    continue
                band, (x0, y0, res, _), missing = tiff_band(content)
                for r in range(0, len(band), 64):  # a few rows at a time
                    part = band[r : r + 64].astype(np.float64)
                    ok = np.isfinite(part) & (part != missing if missing is not None else True)
                    row, col = np.nonzero(ok)
                    if len(row):
                        yield pd.DataFrame({"source_file": name, "row": row + r, "col": col, "v": part[ok], "x0": x0, "y0": y0, "res": res})

    return _files(spark, path).mapInPandas(run, PIXELS)


# ---------------------------------------------------------------- OSM


def osm_objects(content: bytes) -> Iterator[tuple]:
    """id, type, tags and geometry of the tagged objects in OSM XML: nodes as points, open ways as lines, closed ones as polygons."""
    import xml.etree.ElementTree as ET

    where: dict[str, tuple[float, float]] = {}
    for _, x in ET.iterparse(io.BytesIO(content)):
        if x.tag not in ("node", "way"):
            continue
        tags = {t.get("k"): t.get("v") for t in x.findall("tag")}
        geometry = None
        if x.tag == "node":
            p = where[x.get("id", "")] = (float(x.get("lon", "nan")), float(x.get("lat", "nan")))
            geometry = codecs.from_coordinates("Point", p)
        else:
            points = [where[r] for n in x.findall("nd") if (r := n.get("ref", "")) in where]
            if len(points) >= 4 and points[0] == points[-1]:
                geometry = codecs.from_coordinates("Polygon", [points])
            elif len(points) >= 2:
                geometry = codecs.from_coordinates("LineString", points)
        if tags and geometry:
            yield int(x.get("id", 0)), x.tag, tags, geometry
        x.clear()


def osm_layer(spark: SparkSession, path: str, wanted: dict, category: str) -> DataFrame:
    """id, type, tags, geom_, source, category of the objects with any wanted tag. One scan serves any number of layers: filter its tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(osm_objects(bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "type", "tags", "geom_"])

    scan = _files(spark, path).mapInPandas(run, f"id long, type string, tags map<string,string>, geom_ {codecs.GEOMETRY}")
    return scan.where(scalar.tags_match("tags", wanted)).withColumns({"source": F.lit("OSM"), "category": F.lit(category)})


# ---------------------------------------------------------------- listings


def latest_delivery(spark: SparkSession, path: str) -> str | None:
    """The file under a path whose name has the latest delivery date."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(scalar.deliverable_date("path").isNotNull()).agg(F.max_by("path", scalar.deliverable_date("path"))).first()[0]
