"""Compression of vectors into codes: product quantisation by Hamerly's form of Lloyd's algorithm.

Vectors become integers and are cut into ``parts`` equal consecutive parts.  Each part position has a codebook, which
starts as that part of the first vectors by vec_id.  A round is a pass over a table in the shared folder that holds for every
part its entry, one upper bound of its distance from that entry, and one lower bound of its distance from the second nearest.
When entries move, the upper bound grows by its own entry's way and the lower bound shrinks by the longest way of any other.
Where the upper bound is strictly below the lower one, or below half the way from the part's entry to the entry next to it, the
part keeps its entry unseen; else the upper bound is made exact, and where that doesn't help, the part is compared with all
entries in integers.  Bounds are stored in 32 bits, rounded outwards, and only a strict inequality spares a comparison, so the entry is
always the nearest, of equally near ones that with the lowest index.

New entries are sums of their parts, added up in the tasks: what reaches the driver is one row for each place of
the codebooks, whose size doesn't depend on the number of vectors.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; a shorter vector counts as having
zeros behind, up to the table's longest, and so does the last part where the length isn't divisible; scaled components are held
within 2**24, so that squares add up exactly; fewer than 64 vectors give fewer entries; rows of one vec_id take places in the order of their
components, rows without vec_id the last ones; repeated rows each get their row; empty vectors have error 0; an empty table gives an empty table; a label's
error that doesn't fit a long is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vector_sums import finite, matrix, scaled, summed

SCALE, MOST = 256, 1 << 24
CHUNK = 2048
_STATE = "vec_id long, label int, x array<long>, entry array<short>, upper array<float>, lower array<float>, scans int"


@dataclass(frozen=True)
class Codes:
    """The rows (vec_id, label, code, error, scans) and the codebooks (part, entry, place) they were made with."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def integer_rows(vectors: DataFrame) -> DataFrame:
    return vectors.where(finite("embedding")).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), scaled("embedding", SCALE, MOST).alias("x"))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (rows, places) from entries (entries, places)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:  # every sum on the way is a whole number that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)


def _above(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf).astype(np.float32), np.float32(np.inf))


def _below(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf).astype(np.float32), np.float32(-np.inf))


@dataclass(frozen=True)
class Moves:
    """What a change of the codebooks does to the bounds, by part and entry: the entry's own way, the longest way of
    any other entry, and half the distance to the entry next to it."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray) -> Moves:
        own = _above(((new - old) ** 2).sum(axis=2)).astype(np.float64)
        parts, k = own.shape
        others, half = np.zeros((parts, k)), np.full((parts, k), np.inf)
        if k > 1:
            order = np.sort(own, axis=1)
            others = np.where(own == order[:, -1:], order[:, -2:-1], order[:, -1:])  # of two that move equally far, the other
            for p in range(parts):
                apart = _distances(new[p], new[p])
                np.fill_diagonal(apart, np.iinfo(np.int64).max)
                half[p] = _below(apart.min(axis=1)).astype(np.float64) / 2
        return cls(own, others, half)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, the lowest of several, and the bounds."""
    squares = _distances(x, book)
    best = squares.argmin(axis=1)
    at = np.arange(len(x))
    upper = _above(squares[at, best])
    if len(book) == 1:
        return best, upper, np.full(len(x), np.inf, np.float32)
    squares[at, best] = np.iinfo(np.int64).max
    return best, upper, _below(squares.min(axis=1))


def assign(x: np.ndarray, books: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moves: Moves | None):
    """Entries, bounds and number of full comparisons of rows (rows, parts, places); the state is that under the codebooks before ``moves``."""
    rows, parts = x.shape[:2]
    entry = np.zeros((rows, parts), np.int64)
    upper, lower, scans = np.zeros((rows, parts), np.float32), np.zeros((rows, parts), np.float32), np.zeros(rows, np.int32)
    for p in range(parts):
        if state is None:
            unsure = np.arange(rows)
        else:
            e = state[0][:, p].astype(np.int64)
            u = np.nextafter((state[1][:, p].astype(np.float64) + moves.own[p][e]).astype(np.float32), np.float32(np.inf))
            low = np.nextafter((state[2][:, p].astype(np.float64) - moves.others[p][e]).astype(np.float32), np.float32(-np.inf))
            bound = np.maximum(low, moves.half[p][e])
            unsure = np.flatnonzero(~(u < bound))
            u[unsure] = _above(((x[unsure, p] - books[p][e[unsure]]) ** 2).sum(axis=1))
            unsure = unsure[~(u[unsure] < bound[unsure])]
            entry[:, p], upper[:, p], lower[:, p] = e, u, low
        if len(unsure):
            entry[unsure, p], upper[unsure, p], lower[unsure, p] = _scan(x[unsure, p], books[p])
            scans[unsure] += 1
    return entry, upper, lower, scans


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind))


def _state(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lambda name: np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, parts)
    return flat("entry"), flat("upper"), flat("lower")


def _cut(column: pa.Array, parts: int, places: int) -> np.ndarray:
    return matrix(column, parts * places).reshape(len(column), parts, places)


def _round(table: DataFrame, books: np.ndarray, moves: Moves | None) -> DataFrame:
    """The table with entries and bounds under ``books``."""
    parts, _, places = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                entry, upper, lower, scans = assign(_cut(batch.column("x"), parts, places), books, _state(batch, parts) if moves else None, moves)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("x"), _lists(entry.astype(np.int16), pa.int16()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.array(scans)],
                    ["vec_id", "label", "x", "entry", "upper", "lower", "scans"],
                )

    return table.mapInArrow(run, _STATE)


def _moved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as its parts' mean, rounded down; an entry without parts stays."""
    parts, k, places = books.shape

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x, entry = _cut(batch.column("x"), parts, places), _state(batch, parts)[0].astype(np.int64)
        total = np.zeros((parts * k, places + 1), np.int64)
        at = (entry + np.arange(parts) * k).ravel()
        np.add.at(total, at, np.concatenate([x, np.ones((*entry.shape, 1), np.int64)], axis=2).reshape(len(at), places + 1))
        return total.ravel().astype(object)

    total = summed(table, of, parts * k * (places + 1), integers=True).reshape(parts, k, places + 1)
    out = books.copy()
    for p in range(parts):
        for e in range(k):
            if n := total[p, e, places]:
                out[p, e] = [s // n for s in total[p, e, :places]]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codes:
    """Codes of every vector that counts, after ``rounds`` rounds of Lloyd's algorithm and a last assignment."""
    table = written(integer_rows(vectors), "codes-rows")
    places = -(-(table.agg(F.max(F.size("x"))).first()[0] or 0) // parts)
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.zeros((len(first), parts * places), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row["x"])] = row["x"]
    books, moves = start.reshape(len(first), parts, places).transpose(1, 0, 2).copy(), None
    for _ in range(rounds if first else 0):
        table = written(_round(table, books, moves), "codes-round")
        new = _moved(table, books)
        books, moves = new, Moves.between(books, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                x = _cut(batch.column("x"), parts, places)
                entry, _, _, scans = assign(x, books, _state(batch, parts) if moves else None, moves)
                away = x - books[np.arange(parts), entry]
                code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array((away * away).sum(axis=(1, 2))), pa.array(scans)], ["vec_id", "label", "code", "error", "scans"])

    return Codes(written(table.mapInArrow(run, "vec_id long, label int, code string, error long, scans int"), "codes-done"), books)


def with_label_error(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row; rows without label are one label."""
    totals = written(codes.rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    joined = codes.rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
