"""Queries that SQL can express give the rows that DuckDB gives."""

import parity
import pytest
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert parity.compare(parity.connect(SF), QUERIES[name](spark, SF), ORACLE_SQL[name]) == ""
