"""Codes against a plain Lloyd's algorithm that compares every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest
from parity import compare, connect
from tidemark.llm import vector_codes as V
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    places = -(-max((len(v) for _, v, _ in ok), default=0) // parts)
    x = [[max(-V.MOST, min(V.MOST, math.floor(256 * float(np.float32(c))))) for c in v] + [0] * (parts * places - len(v)) for _, v, _ in ok]
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, x[i][: len(ok[i][1])]))
    cut = lambda v, p: v[p * places : (p + 1) * places]
    books = [[cut(x[i], p) for i in order[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in x]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if mine := [cut(v, p) for v, n in zip(x, near, strict=True) if n[p][1] == e]:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    by = {}
    for (_, _, label), error in zip(ok, errors, strict=True):
        by[label] = by.get(label, 0) + error
    return sorted((str(i), "".join(f"{e:02x}" for _, e in n), error, by[label], digest) for (i, _, label), n, error in zip(ok, near, errors, strict=True))


def found(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_equals_sql(spark):
    assert compare(connect("/root/testdata/sf0.001"), QUERIES["op12_vector_codes"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op12_vector_codes"]) == ""


def test_ties_copies_and_odd_rows(spark):
    r = random.Random(2)
    # few different values: ties between entries, entries alike, parts midway
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(32)], r.choice([None, 1, 1, 1, 2])) for i in range(150)]
    rows += [(5, rows[9][1], 1), (5, rows[8][1], 2), (None, rows[3][1], None), (700, rows[1][1][:19], 3), (701, [], 1), (702, [1e20, -1e20] + [0.5] * 30, 2)]
    rows += [rows[0]] * 40 + [(800, None, 1), (801, [None] * 32, 1), (802, [float("inf")] * 32, None)]
    df = spark.createDataFrame([(i, v, label, "x", 7) for i, v, label in rows], SCHEMA + ", code string, error int").repartition(6)
    assert found(V.with_label_error(V.compress(df))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 2), (2, [], None)], [(4, [0.1] * 5, None)]])
def test_few_rows(spark, rows):
    assert found(V.with_label_error(V.compress(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_bounds_spare_comparisons(spark):
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(16)] for _ in range(8)]
    rows = [(i, [c + r.gauss(0, 0.01) for c in centres[i % 8]], i % 3) for i in range(400)]
    codes = V.compress(spark.createDataFrame(rows, SCHEMA), entries=8)
    assert sum(row["scans"] for row in codes.rows.collect()) < 0.1 * 400 * 16
    assert found(V.with_label_error(codes)) == brute(rows, entries=8)


def test_bounds_hold():
    r = np.random.default_rng(1)
    for trial in range(30):
        k, places = int(r.integers(1, 9)), int(r.integers(1, 4))
        x = r.integers(-6, 7, (200, 2, places))
        old = r.integers(-6, 7, (2, k, places))
        new = old + r.integers(-2, 3, old.shape) * (r.random(old.shape) < 0.3)
        entry, upper, lower, _ = V.assign(x, old, None, None)
        got = V.assign(x, new, (entry, upper, lower), V.Moves.between(old, new))
        squares = ((x[:, :, None] - new[None]) ** 2).sum(axis=3)
        assert (got[0] == squares.argmin(axis=2)).all()
        ordered = np.sqrt(np.sort(squares, axis=2))
        assert (got[1] >= ordered[:, :, 0]).all() and (k == 1 or (got[2] <= ordered[:, :, 1]).all())
