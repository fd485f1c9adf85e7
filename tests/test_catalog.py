"""Every registered query runs, and equals its oracle where it has one (smallest scale)."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline"))
def test_query(name, spark, con, small_dir):
    df = QUERIES[name](spark, small_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
