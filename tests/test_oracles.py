"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

from inkstone import queries as Q

SF = "/root/testdata/sf0.001"
NAMES = sorted(Q.queries())


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare.spark_rows(Q.queries()[name](spark, SF)) == compare.sql_rows(con, Q.oracle_sql()[name])
