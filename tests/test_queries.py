"""Every registered query against its SQL on the smallest tables."""

import pytest

from cladeframe.plans import registry
from tests.conftest import SMALL

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
