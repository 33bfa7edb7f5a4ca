import pytest

from meshloom.llm import queries
from oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.SQL[name], "/root/testdata/sf0.001")
