"""Sinks: GeoJSON lines, layers by state, merged files, cached results, numbered models, feature matrices."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators.preprocess import Scaling
from voltweave.sources import codecs


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result is there."""
    fs, p = _path(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(p))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame | None], force: bool = False) -> DataFrame | None:
    """The result at a path, made and written first if it isn't there or force is set; None, unwritten, if there is nothing."""
    if force or not exists(spark, path):
        df = make()
        if df is None:
            return None
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_geojson(df: DataFrame, path: str, geometry: str = "geom_") -> None:
    """A GeoJSON feature per line; other columns become properties."""
    properties = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), F.coalesce(codecs.geometry_to_geojson(F.col(geometry)), F.lit("null")), F.lit("}"))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geom_") -> None:
    df.withColumn("geometry", codecs.geometry_to_wkb(F.col(geometry))).drop(geometry).write.mode("overwrite").parquet(path)


def write_by_state(df: DataFrame, path: str, state: str = "state") -> None:
    """A folder per state, the state no longer a column of the files."""
    df.repartition(F.col(state), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(state).parquet(path)


def merge_state(spark: SparkSession, path: str, target: str, state: str, value: str, files: int = 1) -> None:
    """One state's files merged into a few."""
    spark.read.parquet(path).where(F.col(state) == value).coalesce(files).write.mode("overwrite").parquet(target)


def write_matrices(df: DataFrame, path: str, features: list[str], label: str, meta: list[str], scaling: Scaling) -> None:
    """X, y and meta data keyed alike, and the fitted scaling."""
    key = meta[0]
    df.select(key, *features).write.mode("overwrite").parquet(f"{path}/X_all")
    df.select(key, label).write.mode("overwrite").parquet(f"{path}/y_all")
    df.select(*meta).write.mode("overwrite").parquet(f"{path}/meta_all")
    df.sparkSession.createDataFrame([(scaling.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scaling")


def read_scaling(spark: SparkSession, path: str) -> Scaling:
    return Scaling.from_json(spark.read.text(f"{path}/scaling").first()[0])


def next_index(spark: SparkSession, folder: str, stem: str = "model") -> int:
    """The lowest free number N of <stem>_<N> in a folder, gaps filled first."""
    fs, p = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    taken = {int(m[1]) for n in names if (m := re.match(rf"{re.escape(stem)}_(\d+)", n))}
    return next(i for i in range(len(taken) + 1) if i not in taken)


def save_model(spark: SparkSession, model, folder: str, stem: str = "model") -> str:
    path = f"{folder}/{stem}_{next_index(spark, folder, stem)}"
    model.write().save(path)
    return path


def layer_path(base: str, slug: str, category: str, stem: str) -> str:
    return f"{base}/{slug}/{category.upper()}/{stem}"


def write_network(path: str, edges: DataFrame, nodes: DataFrame, terminals: DataFrame) -> None:
    """The three layers of a network, each a GeoJSON-lines folder under one path; geometries are in geom_."""
    for name, layer in (("edges", edges), ("nodes", nodes), ("terminals", terminals)):
        write_geojson(layer, f"{path}/{name}")


def write_tensor(volume: DataFrame, path: str, meta: dict) -> None:
    """A volume (channel, row, values) as Parquet, a folder per channel, and what describes it as JSON."""
    volume.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/volume")
    volume.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_tensor(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/volume"), json.loads(spark.read.text(f"{path}/meta").first()[0])
