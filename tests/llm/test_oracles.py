import pytest

from tests.oracle import compare
from variorum.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", Q.QUERIES[name], Q.ORACLE[name]) == ""
