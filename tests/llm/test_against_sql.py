import pytest
from compare import rows_of, rows_of_sql

from slidelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(sf, queries.SQL[name])
