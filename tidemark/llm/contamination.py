"""Decontamination against a benchmark: multi-pattern search after Wu and Manber, over words.

Words are runs of letters, digits and non-ASCII characters, with A-Z as a-z.  Every window of ``width`` consecutive words
of a benchmark item is a pattern, and so is a shorter item as a whole.  Patterns of one length m are searched for together: a
block is two words (one where m is 1), and a shift table says for each block how far a search may go on without passing a pattern in
which the block occurs; a block of no pattern lets it go on by m - 1 words.  Where the shift is zero, the block may end a pattern:
its hash selects a bucket of patterns with that suffix, the hash of their first block thins the bucket, and a direct comparison of the words
confirms each occurrence.  A task takes many texts at once, and stretches of long ones, each with a place of its own that skips on.

The benchmark is cut by hash into blocks of about ``PATTERNS`` patterns.  One block at a time is read to the driver and sent to the tasks.  With one
block, one pass over the documents gives the result.  With several, each pass sends only the rows that it hits, with the stretches hit
and the items, and these are united by row.

Texts are worked on in pieces of about ``PIECE`` bytes that end between words; the last words of a piece, with what is known of them, are
the first ones of the next, so memory doesn't follow the length of a text.

Defined cases: a null or empty text has no words and isn't hit; a null, empty or wordless item has no window; rows alike each get their row; items
with one item_id count as one; words of an item without item_id are hit, but it isn't listed nor counted; an empty benchmark hits nothing; an empty table gives an
empty table; extra columns are ignored.
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
from .vector_text import buffers, chunks, mix, word_hashes, word_spans

WIDTH = 10
PATTERNS, PIECE, LANE = 200_000, 1 << 20, 256
_SHIFT_BITS = 20
_A = np.uint64(0x9E3779B97F4A7C15)
#: Each byte as it counts in a word; all that is in no word becomes a blank.
_FOLD = np.full(256, 32, np.uint8)
for _byte in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_byte] = _byte
_FOLD[65:91] = np.arange(97, 123)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + right)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, pattern) of each distinct window of each item; words are joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("item_id"), batch.column("text").to_pylist(), strict=True):
                words = _FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode().split(" ")
                words = [w for w in words if w]
                count = max(1, len(words) - width + 1) if words else 0
                for lo in range(0, count, 4096):
                    found = list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(lo, min(count, lo + 4096))))
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(found), pa.string()), pa.array(found)], ["item_id", "pattern"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    return rows.mapInArrow(run, "item_id string, pattern string").distinct()


@dataclass
class Group:
    """Search tables for patterns of one length; ``first`` and ``bucket`` are sorted by suffix hash."""

    length: int
    shift: np.ndarray
    suffix: np.ndarray
    prefix: np.ndarray
    words: list[tuple[bytes, ...]]
    items: list[list[str]]

    @classmethod
    def of(cls, length: int, patterns: dict[bytes, list[str]]) -> Group:
        texts = list(patterns)
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends, _ = word_spans(data, at)
        h = word_hashes(data, starts, ends, lower=False).reshape(len(texts), length)
        blocks = _pair(h[:, :-1], h[:, 1:]) if length > 1 else h
        shift = np.full(1 << _SHIFT_BITS, max(1, length - 1), np.uint8)
        for j in range(blocks.shape[1]):  # from the front, so that the last place of a block counts
            np.minimum.at(shift, blocks[:, j] >> np.uint64(64 - _SHIFT_BITS), blocks.shape[1] - 1 - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        return cls(length, shift, blocks[order, -1], blocks[order, 0], [tuple(texts[i].split()) for i in order], [patterns[texts[i]] for i in order])

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(last word, pattern) of every occurrence in the texts whose words begin at ``first``."""
        m = self.length
        texts = np.flatnonzero(np.diff(first) >= m)
        if not len(texts):
            return []
        lo, hi = first[texts] + m - 1, first[texts + 1]
        lanes = -(-(hi - lo) // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        at = lo[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(at + LANE, hi[owner])
        ends_at, blocks_at = [], []
        while len(at):
            block = _pair(h[at - 1], h[at]) if m > 1 else h[at]
            step = self.shift[block >> np.uint64(64 - _SHIFT_BITS)].astype(np.int64)
            stop = step == 0
            ends_at.append(at[stop])
            blocks_at.append(block[stop])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        return self._confirm(np.concatenate(ends_at), np.concatenate(blocks_at), data, starts, ends, h)

    def _confirm(self, at: np.ndarray, block: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        some = hi > lo
        at, lo, size = at[some], lo[some], (hi - lo)[some]
        place = np.repeat(np.arange(len(at)), size)
        pattern = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + lo[place]
        last = at[place]
        begin = last - self.length + 1
        head = _pair(h[begin], h[begin + 1]) if self.length > 1 else h[begin]
        alike = head == self.prefix[pattern]
        raw, out = data.tobytes() if alike.any() else b"", []
        for i, p in zip(last[alike].tolist(), pattern[alike].tolist(), strict=True):
            if tuple(raw[starts[i - self.length + 1] : ends[i]].split()) == self.words[p]:
                out.append((i, p))
        return out


class Matcher:
    """Finds the patterns of one block of the benchmark."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        by_length: dict[int, dict[bytes, list[str]]] = {}
        for item, pattern in rows:
            text = f" {pattern}".encode()
            items = by_length.setdefault(text.count(b" "), {}).setdefault(text, [])
            if item is not None:
                items.append(item)
        self.groups = [Group.of(m, patterns) for m, patterns in sorted(by_length.items())]
        self.longest = max(by_length, default=1)

    def find(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]], tuple[np.ndarray, np.ndarray]]:
        """For folded texts: whether each word is hit, each text's first word, its items, and the words' bounds."""
        starts, ends, first = word_spans(data, at)
        h = word_hashes(data, starts, ends, lower=False)
        turns = np.zeros(len(starts) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(len(at) - 1)]
        for group in self.groups:
            found = group.search(data, starts, ends, h, first)
            if found:
                last, pattern = np.array(found).T
                np.add.at(turns, last - group.length + 1, 1)
                np.add.at(turns, last + 1, -1)
                for text, p in set(zip((np.searchsorted(first, last, "right") - 1).tolist(), pattern.tolist(), strict=True)):
                    items[text].update(group.items[p])
        return np.cumsum(turns[:-1]) > 0, first, items, (starts, ends)

    def whole(self, raw: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Hits of one text's words and its items, worked through in pieces."""
        parts, items = [], set()
        kept, known = np.zeros(0, np.uint8), np.zeros(0, bool)
        lo = 0
        while lo < len(raw):
            hi = min(lo + PIECE, len(raw))
            while hi < len(raw):  # to the end of the word
                gap = np.flatnonzero(_FOLD[raw[hi : hi + PIECE]] == 32)
                hi = min(len(raw), hi + (int(gap[0]) if len(gap) else PIECE))
                if len(gap):
                    break
            data = np.concatenate([kept, _FOLD[raw[lo:hi]]])
            hit, _, found, (starts, _) = self.find(data, np.array([0, len(data)]))
            hit[: len(known)] |= known
            items |= found[0]
            back = min(len(starts), self.longest - 1) if hi < len(raw) else 0
            cut = len(starts) - back
            parts.append(hit[:cut])
            kept, known = (data[starts[cut] :], hit[cut:]) if back else (data[:0], hit[:0])
            kept = np.concatenate([kept, [np.uint8(32)]]).astype(np.uint8)
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, bool), items

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, set[str]]]:
        """(hits of its words, items) of each text in turn."""
        for lo, hi, data, at in chunks(column, PIECE):
            if hi - lo == 1 and len(data) > PIECE:
                yield self.whole(data)
                continue
            hit, first, items, _ = self.find(_FOLD[data], at)
            for i, found in enumerate(items):
                yield hit[first[i] : first[i + 1]], found


def _stretches(hit: np.ndarray) -> list[int]:
    """First and end of each stretch of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _verdict(n_hit: int, items) -> tuple:
    return n_hit, len(items), _digest(items), n_hit > 0


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_ROWS = "row long, doc_id long, n_words long"


def _blocks(patterns: DataFrame, size: int) -> Iterator[tuple[int, int, list]]:
    """(number, of how many, patterns) of the benchmark's blocks; one at a time comes to the driver."""
    total = patterns.count()
    n = max(1, -(-total // size))
    for k in range(n):
        yield k, n, [tuple(r) for r in patterns.where(F.pmod(F.xxhash64("item_id", "pattern"), F.lit(n)) == k).collect()]


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, size: int = PATTERNS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    spark = docs.sparkSession
    patterns = written(windows(benchmark, width), "patterns")
    texts, hits = docs.select(F.col("doc_id").cast("long"), "text"), None
    for k, n, rows in _blocks(patterns, size):
        sent = spark.sparkContext.broadcast(rows)
        if n == 1:
            return _judged(texts, sent)
        if k == 0:  # rows get a number that holds for all passes
            texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "contamination-texts")
        own = written(_hits(texts, sent), "contamination-hits")
        hits = own if hits is None else hits.union(own)
        sent.unpersist()
    return _united(texts, hits)


def _judged(texts: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            out = [(len(hit), *_verdict(int(hit.sum()), items)) for hit, items in matcher.texts(batch.column("text"))]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return texts.mapInArrow(run, _RESULT)


def _hits(texts: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            out = [(row, _stretches(hit), sorted(items)) for row, (hit, items) in zip(batch.column("row").to_pylist(), matcher.texts(batch.column("text")), strict=True) if hit.any()]
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], ["row", "stretches", "items"])

    return texts.select("row", "text").mapInArrow(run, "row long, stretches array<long>, items array<string>")


def _united(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The result of several blocks: a row's stretches, at most one for each block, are united."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for lo, hi, data, at in chunks(batch.column("text"), PIECE):
                _, _, first = word_spans(_FOLD[data], at)
                words += np.diff(first).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words, pa.int64())], ["row", "doc_id", "n_words"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, many, items in zip(batch.column("n_words").to_pylist(), batch.column("many").to_pylist(), batch.column("items").to_pylist(), strict=True):
                turns = np.zeros(n + 1, np.int32)
                for one in many or []:
                    np.add.at(turns, one[::2], 1)
                    np.add.at(turns, one[1::2], -1)
                out.append(_verdict(int((np.cumsum(turns) > 0).sum()), {i for x in items or [] for i in x}))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    by_row = hits.groupBy(F.col("row").alias("of")).agg(F.collect_list("stretches").alias("many"), F.collect_list("items").alias("items"))
    rows = texts.mapInArrow(count, _ROWS).join(by_row, F.col("row") == F.col("of"), "left")
    return rows.select("doc_id", "n_words", "many", "items").mapInArrow(unite, _RESULT)
