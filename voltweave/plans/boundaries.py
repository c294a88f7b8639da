"""Boundaries by name: the mask that a run clips its layers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.operators import polygons

#: Columns that may hold a boundary's name, the first present one counts (fixed values).
NAME_COLUMNS = ("NAME", "name", "State_Name")


def name_column(layer: DataFrame, names: tuple[str, ...] = NAME_COLUMNS) -> str:
    found = next((c for c in names if c in layer.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(names)} is there")
    return found


def named_rows(layer: DataFrame, name: str, exact: bool = False, names: tuple[str, ...] = NAME_COLUMNS) -> DataFrame:
    """The rows of that name, case aside unless exact. ValueError if there are none."""
    column = F.col(f"`{name_column(layer, names)}`")
    rows = layer.where(column == name if exact else F.lower(F.trim(column)) == name.strip().lower())
    if rows.isEmpty():
        raise ValueError(f"no boundary is called {name}")
    return rows


def boundary(layer: DataFrame, name: str, exact: bool = False, geometry: str = "geom_") -> DataFrame:
    """One row: the union of the boundaries of that name."""
    return polygons.dissolve(named_rows(layer, name, exact).withColumn("_name", F.lit(name)), "_name", geometry).withColumnRenamed("_name", "name")


def clipped(layer: DataFrame, mask: DataFrame, cell: float = 10_000.0) -> DataFrame:
    """The points (id, x, y) of a layer that lie in the mask."""
    return polygons.within_mask(layer, mask, cell)
