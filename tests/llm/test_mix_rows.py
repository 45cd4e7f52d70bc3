"""Rows that are alike are mixed together, and every row stays."""

from collections import Counter

from tidemark.llm import mixing


def test_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 7 + [(None, "d e", "s")] * 3 + [(1, "other text", None)] * 2 + [(2, None, "s"), (3, " ".join(["w"] * 40), "t")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert Counter((f["doc_id"], f["size"], f["source"]) for f in found) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    taken, target, largest = Counter(), {}, Counter()
    for f in found:
        taken[f["source"]] += f["copies"] * f["size"]
        target[f["source"]] = f["target"]
        largest[f["source"]] = max(largest[f["source"]], f["size"])
        assert 0 <= f["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    alike = [f["copies"] for f in found if f["doc_id"] == 1 and f["size"] == 3]
    assert max(alike) - min(alike) <= 1
