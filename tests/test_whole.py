"""Geometry over all orders, on tables that hold more than the first 2,000 ids."""

import os

import pytest
from test_queries import rows

from seqloom import queries as base

DIR = "/root/testdata/sf0.01"
WHOLE = [f"geo_{x}_whole" for x in ("box_intersection", "box_union_area", "box_overlaps", "polygon_union", "polygon_intersection", "polygon_intersection_all")]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_all_orders_count(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{DIR}/orders.parquet'")
    assert rows(base.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(base.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_no_id_is_left_out(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey").collect()}
    assert max(ids) > 2000
    got = {r["id"] for r in base.QUERIES["geo_polygon_intersection_whole"](spark, DIR).select("id").collect()}
    assert got == {i for i in ids if i + 89 in ids}
