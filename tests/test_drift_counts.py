"""What is new or gone comes with the exchanges of the side that has it, counted over all of them."""

import pytest
from parity import compare, connect
from pyspark.sql import functions as F
from tidemark.plans import catalog
from tidemark.plans.sql import SQL

SF = "/root/testdata/sf0.01"


def test_new_endpoints_come_with_their_exchanges(spark):
    ends = {r["endpoint"]: r["n_b"] for r in catalog.QUERIES["drift_endpoints"](spark, SF).where("n_a is null").collect()}
    found = catalog.QUERIES["drift_endpoint_added"](spark, SF).collect()
    assert found and {r["endpoint"]: r["n_b"] for r in found} == ends
    assert all(r["b_samples"] is None for r in found)


def test_lone_statuses_come_with_their_exchanges(spark):
    a, b = ({(r["endpoint"], r["status"]): r["n"] for r in x.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("n")).collect()} for x in catalog._sides(spark, SF))
    found = catalog.QUERIES["drift_statuses"](spark, SF).collect()
    assert {r["kind"] for r in found} == {"status-removed", "status-added"}
    for r in found:
        key = r["endpoint"], r["status"]
        assert (r["n_a"], r["n_b"]) == (a.get(key), b.get(key)) and (r["n_a"] is None) == (r["kind"] == "status-added")
        assert r["b_samples"] is None


@pytest.mark.parametrize("name", ["drift_endpoint_added", "drift_statuses"])
def test_counts_are_those_of_sql(spark, name):
    assert compare(connect(SF), catalog.QUERIES[name](spark, SF), SQL[name]) == ""
