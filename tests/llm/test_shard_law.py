"""The law of the shards: near equal bytes, and groups of equal texts whole unless heavier than a shard."""

import random
from collections import defaultdict

import pytest
from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(r, groups):
    rows = [(i, " ".join(r.choice("abcdef") * r.randint(1, 9) for _ in range(r.randint(1, 120))), r.choice(["en", "de", None]), r.choice(["s0", "s1", "hot", "hot", None])) for i in range(1500)]
    for g, size in enumerate(groups):
        text = f"group {g} {size} " * 50
        rows += [(len(rows) + k, text, r.choice(["en", "de"]), r.choice(["s0", "s1"])) for k in range(size)]
    return rows


@pytest.mark.parametrize("groups", [(2, 3, 5, 8, 13, 20, 34, 40), (30, 30, 30, 30, 30, 30)])
def test_bytes_near_equal_and_groups_whole(spark, groups):
    rows = corpus(random.Random(len(groups)), groups)
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(4), depth=4).collect()
    text, size, where = {r[0]: r[1] for r in rows}, defaultdict(int), defaultdict(set)
    for f in found:
        size[f["shard"]] += f["size"]
        where[text[f["doc_id"]]].add(f["shard"])
    mean = sum(size.values()) / 16
    assert len(found) == len(rows) and len(size) == 16
    assert all(len(s) == 1 for s in where.values())
    assert max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean


def test_a_group_heavier_than_a_shard_is_divided(spark):
    rows = corpus(random.Random(1), (900,))
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), depth=4).collect()
    size = defaultdict(int)
    for f in found:
        size[f["shard"]] += f["size"]
    mean = sum(size.values()) / 16
    assert max(size.values()) <= 1.1 * mean and min(size.values()) >= 0.9 * mean


def test_equal_rows_and_ties(spark):
    rows = [(1, "same", "en", "s")] * 40 + [(i, "same size", "en", "s") for i in range(40)]
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), depth=2).collect()
    assert len(found) == 80 and {f["shard"] for f in found} <= {0, 1, 2, 3}
