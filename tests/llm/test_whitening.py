"""Components and whitening against numpy's eigenvectors and exact integers."""

import math
import random

import numpy as np
import pytest
from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16):
    """{vec_id: ([whitened], deviation)}, explained, n; signs are the caller's."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for i, v in ok}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = {i: ((np.array([n * a - b for a, b in zip(v, s, strict=True)]) / n) @ vectors / np.sqrt(values), sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in x.items()}
    return white, values / (np.trace(c.T @ c) / n), n


def check(found, rows, k=16):
    white, share, n = brute(rows, k)
    by = {}
    for f in found:
        by.setdefault(f["vec_id"], {})[f["component"]] = f
    assert set(by) == set(white)
    sign = np.ones(k)
    for j in range(k):
        i = max(white, key=lambda i: abs(white[i][0][j]))
        sign[j] = np.sign(white[i][0][j] * by[i][j + 1]["whitened"])
    for i, (w, deviation) in white.items():
        assert sorted(by[i]) == list(range(1, k + 1))
        assert np.allclose([by[i][j + 1]["whitened"] * sign[j] for j in range(k)], w, atol=1e-7)
        assert {f["deviation"] for f in by[i].values()} == {deviation} and {f["n"] for f in by[i].values()} == {n}
        assert np.allclose([by[i][j + 1]["explained"] for j in range(k)], share, rtol=1e-9)
        assert max(f["identity_error"] for f in by[i].values()) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    found = QUERIES["op11_whitening"](spark, f"/root/testdata/{sf}")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    check(found.collect(), rows)


def test_hot_copies_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.2 * (1 + j % 5)) for j in range(40)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, rows[3][1][:11]), (2001, []), (2002, [1e4] * 40)]
    bad = [(3000, None), (3001, [None] * 40), (3002, [float("nan")] * 40), (3003, [float("inf")] + [0.0] * 39)]
    extra = spark.createDataFrame([(i, v, None, 9.0, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, label int, whitened double, component int").repartition(7)
    check(whitening.whiten(extra).collect(), rows)


def test_little_variance(spark):
    line = [(i, [float(i % 5), 2.0 * (i % 5), 0.0]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in line], SCHEMA)).collect()
    assert len(found) == 20 and {f["component"] for f in found} == {1} and abs(found[0]["explained"] - 1) < 1e-12
    for rows in ([], [(1, [0.5, 0.5], 0)] * 3, [(1, [], 0), (None, [], 0)], [(1, None, None)]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]


def test_rows_alike_and_without_id(spark):
    rows = [(i, [float(np.float32(math.sin(i * j + j))) for j in range(1, 9)], 0) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows + [rows[0], rows[0], (None, rows[1][1], None)], SCHEMA), k=4).collect()
    assert len(found) == 33 * 4 and {f["n"] for f in found} == {30}
    at = lambda i: sorted((f["component"], f["whitened"]) for f in found if f["vec_id"] == i)
    assert len(at(0)) == 12 and at(None) == at(1)


def test_huge_entries(spark):
    rows = [(i, [float(i) * 1e30, float(i % 3), -float(i)], 0) for i in range(-5, 6)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), k=2).collect()
    assert len(found) == 11 and all(f["deviation"] is None or f["deviation"] >= 0 for f in found)  # beside that dimension the others have no variance


def test_close_eigenvalues_are_certified(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(160) * 0.3).tolist(), 0) for i in range(600)]
    spread = spark.createDataFrame(rows, SCHEMA).repartition(5)
    f, _ = whitening.fit(whitening.integer_rows(spread))
    assert f.residuals.max() <= whitening.FLOOR * f.values[0] and len(f.values) == 16
    check(whitening.whiten(spread).collect(), [(i, v) for i, v, _ in rows])
