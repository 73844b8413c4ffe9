import pytest

from compare import DATA, connect, same
from granary.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    same(QUERIES[name](spark, str(DATA)), con, SQL[name])
