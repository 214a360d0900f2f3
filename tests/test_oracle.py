import pytest

from heddle.queries.catalog import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    same(spark, sf_dir, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE_SQL])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
