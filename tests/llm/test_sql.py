"""The text queries that SQL can express, against it."""

import oracle
import pytest

from weftline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert oracle.differ(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name]) is None
