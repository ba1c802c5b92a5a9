"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, compare
from shiftledger.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert all(sql for _, sql in CATALOG.values())


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, CATALOG[name][1])
    assert result.startswith("ok"), result
