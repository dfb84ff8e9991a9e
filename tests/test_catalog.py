import pytest

from ramify.catalog import ORACLE_SQL, QUERIES

from .compare import SMALL, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
