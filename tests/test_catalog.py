"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import parity
import pytest
from tidemark.plans.catalog import QUERIES
from tidemark.plans.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert parity.compare(duck, df, SQL[name]) == ""
    else:
        assert df.count() > 0
