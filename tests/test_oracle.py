"""Each query against SQL of the same meaning."""

import pytest
from compare import connected, differs

from quillon.command_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connected(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, sf, name):
    assert differs(spark, con, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_json_path_max_of_all_orders(spark, sf):
    keys = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["json_path_max"](spark, sf).count() == keys


def test_geo_position_of_all_customers(spark, sf):
    got = QUERIES["geo_position"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/customer.parquet").count() and got.filter("lat = -85").count() > 0
