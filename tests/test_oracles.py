"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables on which it has rows."""

from __future__ import annotations

import duckdb
import pytest

from voltweave.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that have no rows on the smallest tables.
LARGER = dict.fromkeys(["tile_rook_components", "sjoin_point_in_box", "parcel_weighted_mean", "pairs_within_group", "patch_windows"], "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in {SF, *LARGER.values()}:
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    yield out
    for c in out.values():
        c.close()


def _key(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, ducks):
    sf = LARGER.get(name, SF)
    df = catalogue.queries()[name](spark, sf)
    result = ducks[sf].execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    assert _key(df.collect()) == _key([tuple(r[i] for i in at) for r in result.fetchall()])


#: Queries without SQL that no test of their own covers.
BARE = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"edge_path_stats", "degree2_stitch", "edge_usage", "training_points", "gbt_oof", "kmeans_folds", "synthetic_links"})


@pytest.mark.parametrize("name", BARE)
def test_query_without_sql_gives_one_row_per_key(name, spark):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
    assert all(x is None or not isinstance(x, float) or x == x for r in rows for x in r)
