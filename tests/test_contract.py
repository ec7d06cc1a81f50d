"""Every named query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tessera.plans import registry
from tools.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
# No SQL twin; tests/test_bruteforce.py holds these against brute force.
BRUTE_FORCE = {"refine_tissue"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(NAMES) - set(registry.oracle_sql()) == BRUTE_FORCE


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith("rows-only" if name in BRUTE_FORCE else "ok"), result
