"""Meetings that fill one document and empty the other at once lose no row."""

import pytest
from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("n", [2, 7, 200])
def test_equal_sizes_keep_every_row(spark, n):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10)), "s") for i in range(n)]
    rows += [(n + i, rows[0][1], "s") for i in range(n % 2)] + [rows[0]] * (n // 4)  # copies, and rows repeated whole
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(f["doc_id"] for f in found) == sorted(r[0] for r in rows)
    target = found[0]["target"]
    assert target == 15 * len(rows) and all(f["copies"] in (1, 2) for f in found)
    assert abs(sum(f["copies"] * f["size"] for f in found) - target) <= 5


def test_one_fills_what_empties_another(spark):
    rows = [(i, " ".join(["w"] * size), "s") for i, size in enumerate([10, 30, 20, 40, 10, 10, 60, 20, 100, 100])]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(f["doc_id"] for f in found) == list(range(len(rows)))
    assert abs(sum(f["copies"] * f["size"] for f in found) - 600) <= 50
