"""Clusters above SHARD_ROWS lose no link to the way they are cut."""

from collections import Counter

import numpy as np
import pytest
from tidemark.llm import vector_graph


@pytest.mark.parametrize("per_centroid", [700, 60])
def test_oversized_group_keeps_every_link(spark, monkeypatch, per_centroid):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(vector_graph, "PER_CENTROID", per_centroid)
    rng = np.random.default_rng(8)
    far = rng.standard_normal((60, 16))
    x = np.concatenate([rng.standard_normal(16) + rng.standard_normal((240, 16)) * 0.06, far])  # a group, and others
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300, x[0].tolist(), 1)]
    x = np.concatenate([x, x[:1]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    rows, links = vector_graph.near_duplicates(df)
    found = {r["vec_id"]: r["n_links"] for r in rows.collect()}
    assert near.sum() > 10_000
    assert found == {i: int(near[i].sum()) for i in range(len(x))}
    assert all(n == 1 for n in Counter((r["a"], r["b"]) for r in links.collect()).values())
