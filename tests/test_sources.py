"""Codecs, readers and sinks by round trips."""

from __future__ import annotations

import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest

from voltweave.operators.preprocess import Scaling
from voltweave.sources import codecs, readers, writers

SHAPES = {
    "Point": (1.0, 2.5),
    "LineString": [(0.0, 0.0), (1.0, 1.0)],
    "Polygon": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]],
    "MultiPoint": [(0.0, 0.0), (1.0, 1.0)],
    "MultiLineString": [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]],
    "MultiPolygon": [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_codecs_round_trip(kind):
    shape = codecs.from_coordinates(kind, SHAPES[kind])
    assert codecs.read_wkb(codecs.write_wkb(shape)) == shape
    assert codecs.read_wkt(codecs.write_wkt(shape)) == shape
    assert codecs.read_geojson(codecs.write_geojson(shape)) == shape


def test_wkb_variants():
    assert codecs.read_wkb(struct.pack(">BIdd", 0, 1, 1, 2))["parts"] == [[[{"x": 1.0, "y": 2.0}]]]
    assert codecs.read_wkb(struct.pack("<BIIdd", 1, 0x20000001, 4326, 1, 2))["parts"] == [[[{"x": 1.0, "y": 2.0}]]]
    assert codecs.read_wkb(struct.pack("<BIddd", 1, 1001, 1, 2, 3))["parts"] == [[[{"x": 1.0, "y": 2.0}]]]
    assert codecs.read_wkt("POINT EMPTY")["parts"] == []


def test_geometry_column_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "POINT (1 2)"), (2, '{"type": "Point", "coordinates": [3, 4]}'), (3, "broken"), (4, None)], "id long, geometry string")
    decoded = codecs.geometry_column(df).drop("geometry")
    rows = {r["id"]: r["geom_"] for r in decoded.collect()}
    assert rows[1]["parts"][0][0][0]["y"] == 2 and rows[2]["parts"][0][0][0]["x"] == 3 and rows[3] is None and rows[4] is None
    writers.write_geoparquet(decoded, str(tmp_path / "g"))
    again = readers.parquet_layer(spark, str(tmp_path / "g"))
    assert again.where("geom_ is not null").count() == 2
    writers.write_geojson(decoded, str(tmp_path / "j"))
    for p in (tmp_path / "j").glob("part-*"):
        p.rename(p.with_suffix(".geojsonl"))
    back = readers.columns_from(readers.features(spark, str(tmp_path / "j")), ["id"])
    assert sorted(r["id"] for r in back.where("geom_ is not null").collect()) == ["1", "2"]
    assert readers.parquet_layer(spark, str(tmp_path / "none"), missing_ok=True) is None


def test_parts(spark):
    df = spark.createDataFrame([(1, codecs.write_wkt(codecs.from_coordinates("MultiLineString", SHAPES["MultiLineString"])))], "id long, geom string")
    parts = codecs.exploded_parts(codecs.geometry_column(df)).orderBy("part_").collect()
    assert [(r["part_"], r["geom_"]["kind"]) for r in parts] == [(0, "LineString"), (1, "LineString")]


def geopackage(path, rows):
    db = sqlite3.connect(path)
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('roads', 'geom')")
    db.execute("create table roads (fid integer primary key, name text, geom blob)")
    for name, shape in rows:
        db.execute("insert into roads (name, geom) values (?, ?)", (name, b"GP\x00\x01" + struct.pack("<i", 4326) + codecs.write_wkb(shape)))
    db.commit()
    db.close()


def test_geopackage_and_zip(spark, tmp_path):
    shapes = [("a", codecs.from_coordinates("LineString", SHAPES["LineString"])), ("b", codecs.from_coordinates("Polygon", SHAPES["Polygon"]))]
    (tmp_path / "in").mkdir()
    geopackage(tmp_path / "in/roads.gpkg", shapes)
    with zipfile.ZipFile(tmp_path / "in/more.zip", "w") as z:
        z.writestr("x/one.geojson", '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "c", "n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": null}]}')
    got = readers.columns_from(readers.features(spark, str(tmp_path / "in")), ["name", "n"])
    assert sorted((r["name"] or "", r["n"], r["geom_"] and r["geom_"]["kind"]) for r in got.collect()) == [("", None, None), ("a", None, "LineString"), ("b", None, "Polygon"), ("c", "1", "Point")]


def tiff(values: np.ndarray, missing: str, deflate: bool) -> bytes:
    rows, cols = values.shape
    data = values.astype("<f4").tobytes()
    data = zlib.compress(data) if deflate else data
    extra = struct.pack("<3d", 30.0, 30.0, 0.0) + struct.pack("<6d", 0, 0, 0, 1000.0, 2000.0, 0) + missing.encode() + b"\0"
    base = 8 + len(data)
    tags = [(256, 3, 1, cols), (257, 3, 1, rows), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, base), (33922, 12, 6, base + 24), (42113, 2, len(missing) + 1, base + 72)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, base + len(extra)) + data + extra + ifd


@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff_pixels(spark, tmp_path, deflate):
    values = np.arange(12, dtype=float).reshape(3, 4)
    values[1, 2] = -9999
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.tif").write_bytes(tiff(values, "-9999", deflate))
    rows = readers.raster_pixels(spark, str(tmp_path / "r")).collect()
    assert {(r["row"], r["col"]): r["v"] for r in rows} == {(r, c): values[r, c] for r in range(3) for c in range(4) if (r, c) != (1, 2)}
    assert (rows[0]["x0"], rows[0]["y0"], rows[0]["res"]) == (1000.0, 2000.0, 30.0)


def test_osm_scan(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/x.osm").write_text(
        '<osm><node id="1" lon="0" lat="0"/><node id="2" lon="1" lat="0"/><node id="3" lon="1" lat="1"><tag k="power" v="tower"/></node>'
        '<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="power" v="line"/><tag k="voltage" v="13800"/></way>'
        '<way id="11"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="landuse" v="industrial"/></way></osm>'
    )
    got = readers.osm_layer(spark, str(tmp_path / "o"), {"power": ["line", "minor_line"], "landuse": "industrial"}, "grid")
    assert sorted((r["id"], r["geom_"]["kind"], r["category"]) for r in got.collect()) == [(10, "LineString", "grid"), (11, "Polygon", "grid")]


def test_results_models_and_states(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert writers.cached(spark, str(tmp_path / "c"), make, force).count() == 3
    assert len(calls) == 2
    for n in (0, 1, 3):
        (tmp_path / f"m/model_{n}").mkdir(parents=True)
    assert writers.next_index(spark, str(tmp_path / "m")) == 2
    df = spark.createDataFrame([("NH", 1), ("VT", 2), ("NH", 3)], "state string, n long")
    writers.write_by_state(df, str(tmp_path / "s"))
    writers.merge_state(spark, str(tmp_path / "s"), str(tmp_path / "nh"), "state", "NH")
    assert len(list((tmp_path / "nh").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "nh")).count() == 2
    matrix = spark.createDataFrame([(1, 0.5, 1), (2, 1.5, 0)], "id long, a double, y int")
    fitted = Scaling.fit(matrix, ["a"])
    writers.write_matrices(fitted.apply(matrix, ["id", "y"]), str(tmp_path / "x"), ["a"], "y", ["id"], fitted)
    assert writers.read_scaling(spark, str(tmp_path / "x")) == fitted


def test_latest_delivery(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for day in ("20230101", "20240305", "20231231"):
        (tmp_path / f"d/NH_Deliverable{day}.zip").write_bytes(b"x")
    assert "20240305" in readers.latest_delivery(spark, str(tmp_path / "d"))
