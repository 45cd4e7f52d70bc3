"""Token counts of whole texts, as the sentencepiece library gives them.

Only lengths leave the Arrow function.  Its input is cut into slices of about equal
bytes.  Inside a slice a text is split where no token can reach across, which is read
from the vocabulary: before a blank that follows another character, if no piece has a
blank after another character, and around line feeds, if no piece joins them to
anything.  Each distinct part is encoded once a slice, in one batch, and kept for the
slices that follow; a text's count is the sum over its parts.  So memory depends on
the slice and the store's bound, not on the length of a text.

Defined cases: a null text counts as empty and has 0 tokens; the library's own default
treats special strings; repeated rows each get their row; an empty table gives an empty
table; extra columns are ignored.  A model without safe boundaries is encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
STORE_PARTS = 400_000
_BLANK = "▁"
_PARTS = re.compile(r"\n| *[^ \n]+| +")


class PieceCounter:
    """Counts tokens with one sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        joins_blank = any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
        joins_line = any("\n" in p and len(p) > 1 for p in pieces)
        # the library itself must agree that blanks are kept as they are and put before a text
        whole = "".join(self._model.id_to_piece(i) for i in self._model.encode("x  y \nz"))
        keeps = whole.replace("<0x0A>", "\n") == f"{_BLANK}x{_BLANK}{_BLANK}y{_BLANK}\nz"
        self._lead = len(self._model.encode("\n"))
        self.splits = not joins_blank and not joins_line and keeps
        self._store: dict[str, int] = {}

    def _encode(self, parts: list[str]) -> list[int]:
        """Tokens of parts inside a text: a line feed before each keeps the library from putting a blank there."""
        return [len(x) - self._lead for x in self._model.encode(["\n" + p for p in parts], num_threads=1)]

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(self._model.encode(t)) if t else 0 for t in texts]
        cut = [_PARTS.findall(" " + t.replace(_BLANK, " ")) if t else [] for t in texts]
        if len(self._store) > STORE_PARTS:
            self._store.clear()
        store = self._store
        new = list({p for parts in cut for p in parts if p not in store})
        store.update(zip(new, self._encode(new), strict=True))
        return [sum(map(store.__getitem__, parts)) for parts in cut]


def _slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(lengths):
        yield lo, len(lengths)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for batch in batches:
            sizes = batch.column("n_bytes").to_pylist()
            for lo, hi in _slices(sizes, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                n = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
