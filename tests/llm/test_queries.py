import pytest
from oracle import compare

from graphloom.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], "/root/testdata/sf0.01")
