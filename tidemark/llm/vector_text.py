"""Vectorised words and shingles on the buffers of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``.  White space is ASCII, so words can be cut in
the UTF-8 bytes without decoding.  All hashes are 64 bits wide: a random value
for each byte times a power of an odd base, summed over the word, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\v\f\r"
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[list(SPACES)] = 0
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_WEIGHTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = _inverse = np.ones(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes;
    a longer text is a run of its own."""
    data, at = buffers(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text its first word's index (one more at the end)."""
    ink = ~_IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= ink[edges]
    last[edges - 1] |= ink[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def _tables(length: int) -> None:
    """Powers of the base and of its inverse, for at least ``length`` places."""
    global _powers, _inverse
    if length > len(_powers):
        _powers = np.cumprod(np.full(length + length // 4, _BASE, np.uint64))
        _inverse = np.cumprod(np.full(length + length // 4, _UNBASE, np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _tables(len(data))
    value = (_VALUE_LOWER if lower else _VALUE)[data]
    value *= _powers[: len(data)]
    np.cumsum(value, out=value)
    total = value[ends - 1]
    total[1:] -= value[ends[:-1] - 1]
    total *= _inverse[starts]
    return mix(total + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles and each one's text; a text with fewer
    words, but at least one, has its whole sequence as its only shingle."""
    count = np.diff(first)
    text_of = np.repeat(np.arange(len(count)), count)
    full = len(words) - width + 1
    parts, owners = [], []
    if full > 0:
        total = np.zeros(full, np.uint64)
        for k in range(width):
            total += words[k : k + full] * _WEIGHTS[k]
        inside = text_of[:full] == text_of[width - 1 :]
        parts.append(total[inside])
        owners.append(text_of[:full][inside])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            total[has] += words[first[short[has]] + k] * _WEIGHTS[k]
        parts.append(total + count[short].astype(np.uint64) * _WEIGHTS[-1])
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(parts)), np.concatenate(owners)


def distinct_by_text(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and where each text's begin."""
    bits = np.uint64(max(1, int(texts).bit_length()))
    packed = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(packed)
    hashes, owner, packed = hashes[order], owner[order], packed[order]
    if ((packed[1:] == packed[:-1]) & (hashes[1:] != hashes[:-1])).any():  # equal in the leading bits only
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    starts, ends, first = word_spans(data, at)
    hashes, owner = shingle_hashes(word_hashes(data, starts, ends), first, width)
    return distinct_by_text(hashes, owner, len(at) - 1)


def list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A list<long> column of unsigned 64-bit values."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
