"""Every registered query against its SQL, on the smallest sample."""

import os

import pytest
from compare import DATA, compare, connect

import __spark_entry__ as E
from tessera import catalog

HERE = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no sample data")


@pytest.fixture(scope="module")
def con():
    return connect(HERE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        assert compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], HERE) is None
    else:
        assert catalog.QUERIES[name](spark, HERE).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
