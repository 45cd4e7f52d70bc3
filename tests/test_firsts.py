"""The bounded first-k aggregate and gapless positions against plain computations."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import endpoints, firsts


def plain(rows, k):
    first = {}
    for g, v, o in rows:
        if o is not None:
            first[g, v] = min(o, first.get((g, v), o))
    out = []
    for g in {g for g, _, _ in rows}:
        mine = sorted((o, v) for (h, v), o in first.items() if h == g)[:k]
        out += [(g, v, o, i + 1) for i, (o, v) in enumerate(mine)]
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [200_000, 3])
def test_first_distinct(spark, monkeypatch, held):
    monkeypatch.setattr(firsts, "HELD", held)
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), f"v{r.randint(0, 60)}", r.choice([None, r.randint(0, 10_000)])) for _ in range(3000)]
    rows += [("c", "x", 5), ("c", "y", 5), ("c", "x", 5)]
    df = spark.createDataFrame(rows, "g string, v string, o long").repartition(5)
    for k in (1, 4, 100):
        got = firsts.first_distinct(df, ["g"], "v", "o", k)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k)


def test_a_task_sends_few_rows(spark):
    """Ten thousand distinct values of one parameter, in falling order: each task sends ten."""
    df = spark.range(10_000).select(F.lit("e").alias("endpoint"), F.lit(1).alias("index"), F.format_string("v%d", "id").alias("value"), (10_000 - F.col("id")).alias("first_ord")).repartition(6)
    sent = firsts.partly(df, ["endpoint", "index"], "value", "first_ord", 10)
    assert sent.groupBy(F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0] <= 10 and sent.count() <= 60
    assert [r["value"] for r in firsts.merged(sent, ["endpoint", "index"], "value", "first_ord", 10).orderBy("rank").collect()] == [f"v{9999 - i}" for i in range(10)]


def test_positions_of_a_hot_endpoint(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else f"e{r.randint(0, 5)}", o, f"id{o}") for o in r.sample(range(100_000), 4000)] + [("hot", 7, "twin a"), ("hot", 7, "twin b")]
    df = spark.createDataFrame(rows, "endpoint string, ord long, id string").repartition(7)
    got = endpoints.exchange_positions(df, "id", parts=12)
    by = {}
    for e, o, i in sorted(rows):
        by.setdefault(e, []).append((o, i))
    assert {tuple(x) for x in got.collect()} == {(e, o, i, k) for e, mine in by.items() for k, (o, i) in enumerate(mine)}
    hot = df.repartitionByRange(12, "endpoint", "ord", "id").where("endpoint = 'hot'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert hot > 5
