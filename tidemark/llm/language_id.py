"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of signs, drawn from its
code point.  A run of three letters is bound into one vector: the first letter's,
permuted twice, times the second's, permuted once, times the third's.  A text is the
bundle (sum) of its runs' vectors, a language the bundle of its training texts, and a
text's language is the prototype with the largest cosine.

Training sums run counts by language inside each task, so a task sends one vector for
each language it met; vectors are summed by Spark.  Prediction works on slices of about
equal length: run counts of the slice's texts times the runs' vectors.  A slice is halved until its texts
times its distinct runs are at most ``CELLS``, a longer text is cut into pieces at gaps (the run
across a cut is counted in the later piece), and vectors are used ``RUNS_AT_ONCE`` at a time, so
memory depends on these bounds, not on the texts or their alphabet.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every
text when there is nothing to learn from; equal cosines go to the least language; repeated
rows each get their row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SLICE_BYTES = 1 << 19
KNOWN_RUNS = 16_384
CELLS = 1 << 21
RUNS_AT_ONCE = 4096
_CODES = 0x110000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(_CODES)), bool, _CODES)
    return _letters


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of three code points (0 is the gap), the run and the text of every occurrence."""
    low = [("\n" + t.lower() + "\n") if t else "\n" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    new = np.append(True, text[1:] != text[:-1])  # a text begins with its gap
    keep |= new
    codes, text = np.where(letter, codes, 0)[keep], text[keep]
    if len(codes) < 3:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet, place = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    inside = text[2:] == text[:-2]
    key = ((place[:-2] * n + place[1:-1]) * n + place[2:])[inside]
    if n**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=1))
        where = np.zeros(n**3, np.int64)
        where[seen] = np.arange(len(seen))
        run = where[key]
    else:
        seen, run = np.unique(key, return_inverse=True)
    return np.stack([alphabet[seen // (n * n)], alphabet[seen // n % n], alphabet[seen % n]], 1).astype(np.int64), run, text[2:][inside]


class Runs:
    """Vectors of runs, made when first met."""

    def __init__(self):
        self._letter: dict[int, np.ndarray] = {}
        self._place: dict[tuple[int, int, int], int] = {}
        self._table = np.zeros((1024, DIMENSIONS), np.float32)

    def _vector(self, code: int) -> np.ndarray:
        if code not in self._letter:
            if len(self._letter) > KNOWN_RUNS:
                self._letter.clear()
            self._letter[code] = np.random.default_rng([7, code]).choice(np.array([-1, 1], np.float32), DIMENSIONS)
        return self._letter[code]

    def vectors(self, runs: np.ndarray) -> np.ndarray:
        triples = list(map(tuple, runs.tolist()))
        if len(self._place) + len(triples) > max(KNOWN_RUNS, len(triples)):
            self._place.clear()
        for t in triples:
            if t not in self._place:
                k = self._place[t] = len(self._place)
                if k == len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                self._table[k] = np.roll(self._vector(t[0]), 2) * np.roll(self._vector(t[1]), 1) * self._vector(t[2])
        return self._table[[self._place[t] for t in triples]]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    texts, lo, size = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES or i - lo >= 2000 or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """A long text's pieces, cut after a letter and a gap, and how many of its first runs the piece before had.

    A later piece begins with the last letter before the gap: of its runs the first, (gap, letter,
    gap), is no run of the text.
    """
    letters, lo, skip = _letter_table(), 0, 0
    while len(text) - lo > SLICE_BYTES:
        hi = lo + SLICE_BYTES
        while hi < len(text) and not (letters[ord(text[hi - 1])] and not letters[ord(text[hi])]):
            hi += 1
        if hi >= len(text):
            break
        yield text[lo:hi], skip
        lo, skip = hi - 1, 1
    yield text[lo:], skip


def _counted(texts: list[str | None], group: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, counts, places): counts of distinct runs in the groups at ``places``, at most ``CELLS`` at a time
    where a single group has not more runs.  ``group`` is the group of each text."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > SLICE_BYTES:
        for piece, skip in _pieces(texts[0]):
            seen, which, _ = letter_runs([piece])
            if len(seen):
                yield seen, np.bincount(which[skip:], minlength=len(seen))[None], group
        return
    seen, which, owner = letter_runs(texts)
    places, inside = np.unique(group, return_inverse=True)
    if len(seen) * len(places) > CELLS and len(texts) > 1:
        half = len(texts) // 2
        yield from _counted(texts[:half], group[:half], groups)
        yield from _counted(texts[half:], group[half:], groups)
    elif len(seen):
        yield seen, np.bincount(inside[owner] * len(seen) + which, minlength=len(places) * len(seen)).reshape(len(places), -1), places


def bundles(runs: Runs, texts: list[str | None], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed vectors of each group's runs, and whether it has a letter."""
    out, has, letters = np.zeros((groups, DIMENSIONS)), np.zeros(groups, bool), _letter_table()
    long = [k for k, t in enumerate(texts) if t and len(t) > SLICE_BYTES]
    parts = [([texts[k]], group[k : k + 1]) for k in long]
    if len(long) < len(texts):
        rest = np.setdiff1d(np.arange(len(texts)), long)
        parts.append(([texts[k] for k in rest], group[rest]))
    for some, where in parts:
        for seen, counts, places in _counted(some, where, groups):
            for lo in range(0, len(seen), RUNS_AT_ONCE):
                part = slice(lo, lo + RUNS_AT_ONCE)
                out[places] += counts[:, part].astype(np.float32) @ runs.vectors(seen[part])
                has[places] |= (counts[:, part] > 0) @ letters[seen[part]].any(1)
    return out, has


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from rows of (text, lang), all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = Runs(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, texts in _slices(batch.column("text")):
                names = sorted(set(langs[lo : lo + len(texts)]))
                number = np.array([names.index(x) for x in langs[lo : lo + len(texts)]])
                for name, s in zip(names, bundles(runs, texts, number, len(names))[0], strict=True):
                    total[name] = total.get(name, 0) + np.rint(s).astype(np.int64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n] for n in names], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # the model: DIMENSIONS numbers for each language
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["k"]] = r["v"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score for every row of ``docs`` (text)."""
    names = list(prototypes)
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    model = docs.sparkSession.sparkContext.broadcast(unit)
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, languages = Runs(), model.value
        for batch in batches:
            for lo, texts in _slices(batch.column("text")):
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if len(languages):
                    found, has = bundles(runs, texts, np.arange(len(texts)), len(texts))
                    cosine = (found @ languages.T) / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                    best = cosine.argmax(1)
                    for i in np.flatnonzero(has):
                        pred[i], score[i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the crc32 of doc_id as text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the rows outside the held-out fold that have text and lang; predicts every row."""
    training = docs.where("text is not null and lang is not null").where(~F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)))
    out = predict(docs, learn(training), keep if "doc_id" in keep else ("doc_id", *keep))
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)))
