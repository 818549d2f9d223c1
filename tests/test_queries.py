"""Every registered query beside its DuckDB SQL, on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as contract  # noqa: E402
from palaver.plans import oracles, registry  # noqa: E402
from tools.check import compare, connect  # noqa: E402

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def test_every_query_has_sql():
    """The package's own queries all do; those that the entry point adds may have none, but no SQL is without its query."""
    assert set(registry.queries()) == set(oracles.oracle_sql())
    assert set(registry.queries()) <= set(QUERIES) and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf, name):
    message, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf)
    assert not message


def test_entry(spark):
    assert contract.entry(spark).count() > 0
