"""Every query outside the subpackages beside its SQL."""

import pytest

from sheaf.plans import registry
from tests.oracle import compare, connection

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(con, SQL[name], QUERIES[name](spark, DATA))


def test_every_query_has_sql_but_one():
    """p4_table is tested against the leaves of its files in test_problems."""
    assert set(QUERIES) - set(SQL) == {"p4_table"}
