"""Every registered query against its oracle SQL on the smallest scale factor."""

import pytest

from guardlens.plans.registry import load
from oracle import compare, connect

QUERIES = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], sf) is None


def test_contract():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.FLAGSHIP in e.queries()
