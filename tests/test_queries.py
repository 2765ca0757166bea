"""Every named query runs, and equals its SQL counterpart where it has one."""

import pytest
from oracle import compare, connect

from shoal.plans import load_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        expected = con.execute(ORACLES[name]).df()
        assert compare(result, expected) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
