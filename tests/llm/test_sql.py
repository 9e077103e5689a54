"""Operators that SQL can express, against their SQL."""

import compare
import pytest

from inkstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare.spark_rows(registry.queries()[name](spark, SF)) == compare.sql_rows(compare.connect(SF), registry.oracle_sql()[name])
