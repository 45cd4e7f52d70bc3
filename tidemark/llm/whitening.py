"""Principal components and whitening of vectors, without forming a covariance matrix.

Entries become integers; the fit list holds each distinct integer vector once.  Components are
the leading eigenvectors of the fit list's covariance V.  V is only ever multiplied with a block of
``k + EXTRA`` columns Q: a Spark pass over the fit list computes X'(XQ) on centred rows, each task's
share being summed by Spark.  After every pass the driver orthogonalises (QR), solves the small
Rayleigh-Ritz problem and takes the residuals |Vu - eu| of the first k Ritz vectors; it ends when all k
are below ``RESIDUAL`` times the greatest eigenvalue, and a last pass on those vectors alone confirms it.

Blocks of earlier passes stay in the Rayleigh-Ritz basis, up to ``BLOCKS`` of them: where eigenvalues lie
close together (65.1 against 65.0 in the sample tables), iteration on the last block alone shrinks the error by a
few hundredths a pass and would take hundreds of them.  The basis then starts again from the Ritz vectors.

An entry is centred as (x - S div n) - (S mod n)/n, so the large offset that all entries share costs no digits.
Memory in a task: one Arrow batch and a block of (dimensions x columns); on the driver: the basis.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; a shorter vector
counts as having zeros behind, up to the table's longest; 64 times an entry is held within 2**40; repeated rows and rows
without vec_id each get their rows; components without variance can't be whitened and are left out, so fewer distinct vectors
or dimensions than k give fewer components, and an empty table, one vector, or empty vectors give no row; ``deviation`` is
null where it doesn't fit a long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vector_sums import finite, matrix, scaled, summed

SCALE, OFFSET, MOST = 64, 1_000_000, 1 << 40
EXTRA, BLOCKS, PASSES = 8, 8, 400
#: Of the greatest eigenvalue: what certifies a component, what is accepted once passes bring no more, and what counts as no variance.
RESIDUAL, FLOOR, FLAT = 1e-13, 1e-10, 1e-12


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, sums by dimension, components (columns), eigenvalues and trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def width(self) -> int:
        return len(self.sums)


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that count."""
    x = F.transform(scaled("embedding", SCALE, MOST), lambda v: v + OFFSET)
    return vectors.where(finite("embedding")).select(F.col("vec_id").cast("long"), x.alias("x"))


def _centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> np.ndarray:
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return (matrix(batch.column("x"), len(sums), OFFSET) - whole) - rest


def _times(fit_list: DataFrame, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """VQ by one pass over the fit list."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        c = _centred(batch, n, sums)
        return (c.T @ (c @ q)).ravel()

    return summed(fit_list, of, q.size).reshape(q.shape) / n


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` has outside ``basis``; no column if that is nothing."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-6]
    u, _ = np.linalg.qr(u - basis @ (basis.T @ u))
    return u[:, : len(basis) - basis.shape[1]]


def components(fit_list: DataFrame, n: int, sums: list[int], k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The leading ``k`` eigenvectors of V as columns, their eigenvalues, their residuals, and the passes it took."""
    d = len(sums)
    k = min(k, d)
    b = min(d, k + EXTRA)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))
    basis = image = np.zeros((d, 0))
    best, since, fresh = np.inf, 0, True
    for passes in range(1, PASSES + 1):
        basis, image = np.hstack([basis, block]), np.hstack([image, _times(fit_list, n, sums, block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:b], turn[:, ::-1][:, :b]
        u, r = basis @ turn, image @ turn - (basis @ turn) * values
        off = np.linalg.norm(r[:, :k], axis=0)
        top = max(values[0], 0.0)
        worst = off.max(initial=0.0)
        best, since = (worst, 0) if worst < 0.5 * best else (best, since + 1)
        certain = worst <= RESIDUAL * top or (since >= 3 and worst <= FLOOR * top)
        if certain and fresh:
            return u[:, :k], values[:k], off, passes
        block = np.zeros((d, 0)) if certain else _new_directions(r, basis)
        fresh = not block.shape[1] or basis.shape[1] + block.shape[1] > BLOCKS * b
        if fresh:  # from the Ritz vectors alone, whose images are computed anew
            block, _ = np.linalg.qr(u)
            basis = image = np.zeros((d, 0))
    raise ArithmeticError(f"after {PASSES} passes a residual is {worst / max(top, 1e-300):.1e} of the greatest eigenvalue")


def fit(rows: DataFrame, k: int = 16) -> tuple[Fit | None, DataFrame]:
    """The fit of ``rows`` (x), None if they have no variance, and the fit list."""
    fit_list = written(rows.select("x").distinct(), "whitening-fit")
    n, width = fit_list.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not width:
        return None, fit_list
    sums = [int(s) for s in summed(fit_list, lambda b: matrix(b.column("x"), width, OFFSET).sum(axis=0).astype(object), width, integers=True)]
    trace = float(summed(fit_list, lambda b: (_centred(b, n, sums) ** 2).sum(axis=0), width).sum()) / n
    if trace <= 0:
        return None, fit_list
    vectors, values, off, passes = components(fit_list, n, sums, k)
    some = values > FLAT * values[0]
    return Fit(n, sums, vectors[:, some], values[some], trace, off[some], passes), fit_list


def identity_error(fit_list: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by a pass over it."""
    k, turn = f.vectors.shape[1], f.vectors / np.sqrt(f.values)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        w = _centred(batch, f.n, f.sums) @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = summed(fit_list, of, k * k + k) / f.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)**2 of each row, exactly."""
    away, rest = x - np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    if (float(np.abs(away).max(initial=0)) * n + n) ** 2 * len(sums) < 2**62:
        return ((away * n - rest) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in ((away.astype(object) * n - rest) ** 2).sum(axis=1)]


def whiten(vectors: DataFrame, k: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that counts and each of up to ``k`` components."""
    rows = integer_rows(vectors)
    f, fit_list = fit(rows, k)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if f is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, turn, share = identity_error(fit_list, f), f.vectors / np.sqrt(f.values), f.values / f.trace
    k = len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                m = part.num_rows
                w = _centred(part, f.n, f.sums) @ turn
                apart = pa.array(_deviation(matrix(part.column("x"), f.width, OFFSET), f.n, f.sums), pa.int64())
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), apart.take(row), pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
