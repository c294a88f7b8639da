"""Deterministic spatial layers over the benchmark tables.

The tables carry no geometry, so coordinates are derived from keys by integer arithmetic that every SQL engine evaluates
alike. Each layer is a table and a list of SQL expressions: Spark selects them, and the checking SQL puts them in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _h(k: str, a: int, b: int, m: int) -> str:
    k = f"cast({k} as bigint)"
    return f"cast((({k} * {a} + {b}) % 1000003) * ({k} % {m} + 1) % 20000 as double)"


def _offset(k: str, factor: int, span: int) -> str:
    return f"cast((cast({k} as bigint) * {factor}) % {2 * span + 1} - {span} as double)"


_PX, _PY = _h("c_custkey", 7919, 12345, 97), _h("c_custkey", 104729, 54321, 97)
_SX, _SY = _h("s_suppkey", 48611, 777, 89), _h("s_suppkey", 86028, 4242, 89)
_BX, _BY = _h("p_partkey", 15487, 31337, 101), _h("p_partkey", 32452, 2718, 101)
_OX, _OY = _h("o_orderkey", 67867, 99991, 103), _h("o_orderkey", 49979, 1618, 103)

#: layer: (table, columns as SQL expressions)
LAYERS: dict[str, tuple[str, list[str]]] = {
    "v_pts": ("customer", ["c_custkey as id", f"{_PX} as x", f"{_PY} as y", "c_acctbal as w", "c_mktsegment as cls", "c_nationkey as nation"]),
    "v_sites": ("supplier", ["s_suppkey as id", f"{_SX} as x", f"{_SY} as y", "s_acctbal as cap", "s_nationkey as nation"]),
    "v_boxes": (
        "part",
        ["p_partkey as id", f"{_BX} as cx", f"{_BY} as cy", "cast(25 + p_size as double) as h", "p_retailprice as val", "p_brand as cls"]
        + [f"{c} {s} cast(25 + p_size as double) as {n}" for c, s, n in ((_BX, "-", "minx"), (_BY, "-", "miny"), (_BX, "+", "maxx"), (_BY, "+", "maxy"))],
    ),
    "v_bldg": ("orders", ["o_orderkey as id", f"{_OX} as x", f"{_OY} as y", "o_totalprice as sqft", "o_orderpriority as cls"]),
    "v_segs": (
        "orders",
        ["o_orderkey as id", f"{_OX} as x1", f"{_OY} as y1", f"{_OX} + {_offset('o_custkey', 1, 200)} as x2", f"{_OY} + {_offset('o_custkey', 31, 200)} as y2", "o_orderpriority as highway", "o_custkey as name_id", "o_totalprice as price"],
    ),
    "v_lines": ("supplier", ["s_suppkey as id", f"{_SX} as x1", f"{_SY} as y1", f"{_SX} + {_offset('s_suppkey', 37, 1500)} as x2", f"{_SY} + {_offset('s_suppkey', 613, 1500)} as y2", "s_nationkey as nation"]),
    "v_pixels": ("lineitem", ["cast(l_orderkey % 200 as bigint) as row", "cast(l_partkey % 200 as bigint) as col", "l_linenumber as v"]),
}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = LAYERS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def with_layers(*names: str) -> str:
    """The layers as the beginning of a WITH clause."""
    return "with recursive " + ", ".join(f"{n} as (select {', '.join(LAYERS[n][1])} from {LAYERS[n][0]})" for n in names)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per pixel: the largest line number."""
    return layer(spark, sf_dir, "v_pixels").groupBy("row", "col").agg({"v": "max"}).withColumnRenamed("max(v)", "v")


RASTER_SQL = "pix as (select row, col, max(v) as v from v_pixels group by row, col)"
