"""Registered queries against their DuckDB oracles on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_contract import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not available")


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["item_code", "target_date", "horizon", "yhat"]
    assert frame.count() == 20 * 56


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, SF_DIR)
    assert ok, note
