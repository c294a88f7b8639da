"""All registered queries of the spatial engine and the SQL that checks them."""

from __future__ import annotations

from voltweave.plans import queries_features, queries_graph, queries_join, queries_ml, queries_raster, queries_scalar, queries_units  # noqa: F401  they register
from voltweave.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
