"""Recall of links over shapes of data that cut clusters, against brute force, and ids that are null or shared."""

import numpy as np
import pytest
from tidemark.llm import vector_graph

SCHEMA = "vec_id long, embedding array<double>, label int"


def groups(rng, many, size, spread=0.1, width=32):
    out = []
    for _ in range(many):
        c = rng.standard_normal(width)
        out.append(c / np.linalg.norm(c) + rng.standard_normal((size, width)) * spread / np.sqrt(width))
    return np.concatenate(out)


def truth(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = np.zeros(len(x), np.int64)
    for one in np.unique(labels):
        k = np.flatnonzero(labels == one)
        n[k] = (u[k] @ u[k].T >= 0.98).sum(1) - 1
    return n


@pytest.mark.parametrize(("many", "size", "labels"), [(1, 3000, 1), (2, 1200, 1), (500, 6, 1), (200, 10, 200)])
def test_recall(spark, many, size, labels):
    rng = np.random.default_rng(many)
    x = np.concatenate([groups(rng, many, size), rng.standard_normal((100, 32))])
    label = np.arange(len(x)) // size % labels
    n = truth(x, label)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], SCHEMA).repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in vector_graph.near_duplicates(df)[0].collect()}
    got = np.array([found[i] for i in range(len(x))])
    assert (got <= n).all() and got.sum() >= 0.99 * n.sum()


def test_poor_recall_falls_back_to_exact_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = groups(rng, 2, 120)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 50)
    monkeypatch.setattr(vector_graph, "audit", lambda *a, **k: 0.5)
    found = {r["vec_id"]: r["n_links"] for r in vector_graph.near_duplicates(df)[0].collect()}
    assert [found[i] for i in range(len(x))] == truth(x, np.ones(len(x))).tolist()


def test_null_and_shared_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a, 1), (7, b, 1), (7, c, 1), (8, c, 1), (None, None, 1), (9, [0.0, 1.0, 0.0], 1), (9, None, 1)]
    found = sorted(map(tuple, vector_graph.near_duplicates(spark.createDataFrame(rows, SCHEMA))[0].collect()), key=str)
    want = [(None, 1, 7, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert found == sorted(want, key=str)
