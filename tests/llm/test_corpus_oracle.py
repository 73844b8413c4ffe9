import pytest

from compare import DATA, connect, same
from granary.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(QUERIES[name](spark, str(DATA)), connect(), SQL[name])
