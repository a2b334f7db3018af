import pytest
from oracle import compare

from graphloom.plans import tables


@pytest.mark.parametrize("name", list(tables.QUERIES))
def test_query_matches_sql(spark, name):
    compare(spark, tables.QUERIES[name], tables.SQL[name])
