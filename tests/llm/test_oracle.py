import pytest

from heddle.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, connect(sf_dir), QUERIES[name], ORACLE_SQL[name])
