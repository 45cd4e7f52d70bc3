"""Byte-pair encoding by speculation and verification, and decoding.

A word's tokens are first guessed by greedy longest match.  A guess is the encoding
exactly when every two neighbours are *compatible*, that is when merging would not
join anything across the border between them before both are complete.  All borders of
all guessed words of a batch are tested at once on numpy arrays, by undoing the two
tokens' merges step by step from the border.  Only words with a failing border undergo
exact merging: short ones together, a round for each merge, and a word of more than
``LONG_WORD`` symbols by itself, rank after rank over the places where each can happen, so its time is
about proportional to its length.

Texts are cut at the library's special strings and at white space; normalising and
cutting into words are those of the tokenizer's own components, once for each distinct
stretch between white space.  Texts are taken in pieces that end at white space, a few hundred thousand
characters at a time; what is kept of stretches is counted in bytes and lies in two generations: when the
younger one has half of ``STORE_BYTES``, the older one goes, but for what was met again meanwhile.  So
memory follows neither the length of a text nor the number of distinct words, and frequent words stay.

Defined cases: a null or blank text has no ids and decodes to the empty text; repeated
rows each get their row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that what is kept of stretches and words may take, and what each is taken to need besides its characters.
STORE_BYTES, ENTRY_BYTES = 360_000_000, 640
LONG_WORD = 64
#: Characters of texts whose stretches are learned together, rows and bytes of a batch of results.
PIECE, SLICE_ROWS, SLICE_BYTES = 1 << 19, 1000, 1 << 22
_GAP = re.compile("[ \n]")
#: Unicode's white space, which the tokenizer's \s matches.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_PLAIN = re.compile(r"[\x1c-\x1f]")
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SIMPLE = re.compile(rf"[{_LATIN}!-&(-/:-@\[-`{{-~]+")
_RUNS = re.compile(rf"[{_LATIN}]+|[^{_LATIN}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabet: printed bytes stand for themselves, the others for 256 and up.
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_NEVER = np.int64(1) << 40


class SpeculativeBPE:
    """Encoder and decoder of one tokenizer file with byte-level BPE and an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a plain BPE tokenizer without decoder or post-processor is needed")
        self._mark = model.get("end_of_word_suffix") or ""
        self._ids: dict[str, int] = model["vocab"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special strings are taken as they stand")
        self._cut = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or r"(?!)")
        size = max([*self._ids.values(), *self._special.values()]) + 1
        self.text_of = np.empty(size, object)
        for t, i in [*self._ids.items(), *self._special.items()]:
            self.text_of[i] = t
        # the merge that makes each token (basic symbols: none), and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys, self._made = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = self._ids[a], self._ids[b], self._ids[a + b]
            if self.rank[z] >= 0:
                raise ValueError("two merges make one token")
            self.rank[z], self.left[z], self.right[z] = r, x, y
            keys[r], self._made[r] = x * size + y, z
        self._size = size
        if (np.maximum(self.rank[keys // size], self.rank[keys % size]) >= np.arange(len(keys))).any():
            raise ValueError("a merge precedes one that makes a part of it")
        self._pairs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        # a token that merging doesn't rebuild from its own characters can't be guessed
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[made] = self._compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self._known = {t: i for t, i in self._ids.items() if sound[i]}
        lengths: dict[str, set[int]] = {}
        for t in self._known:
            if len(t) >= 4:
                lengths.setdefault(t[:4], set()).add(len(t))
        #: lengths of the tokens that begin with four characters, longest first
        self._lengths = {head: sorted(found, reverse=True) for head, found in lengths.items()}
        self._longest = max(map(len, self._known))
        self._store: dict[str, tuple[bytes, str]] = {}
        self._words: dict[str, list[int]] = {}
        self._old: dict[str, tuple[bytes, str]] = {}
        self._whole = any(c.isspace() for t in self._special for c in t)  # a special string with a gap could be cut
        self.held = self.guesses = self.merged = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stand side by side unjoined; with ``end``, until that merge's turn.

        Walks back in time: of the two symbols at the border the one made last is
        undone (of equal ones the right), and a merge of the two counts if its turn comes while both are there.
        A symbol ends when its parent is made: for equal ranks the leftmost goes first,
        so the left symbol's parent precedes a merge across, and the right one's doesn't.
        """
        a, b = a.copy(), b.copy()
        ends_a = np.full(len(a), _NEVER) if end is None else end.astype(np.int64)
        ends_b = ends_a.copy() if end is None else ends_a - 1
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self._pair_rank(x, y)
            bad = (across < ends_a[live]) & (across <= ends_b[live]) & (across < _NEVER)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_a = rx > ry
            k = live[undo_a]
            ends_a[k], a[k] = rx[undo_a], self.right[x[undo_a]]
            k = live[~undo_a]
            ends_b[k], b[k] = ry[~undo_a], self.left[y[~undo_a]]
        return good

    def _symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self._mark]

    def _greedy(self, word: str) -> list[int] | None:
        full, known, lengths, out, i = word + self._mark, self._known, self._lengths, [], 0
        n = len(word)
        while i < n:
            if n - i <= self._longest and (t := known.get(full[i:])) is not None:
                out.append(t)
                return out
            for k in (*lengths.get(word[i : i + 4], ()), 3, 2, 1):
                # the last character ends with the mark, so it is in no token before
                if i + k < n and (t := known.get(word[i : i + k])) is not None:
                    out.append(t)
                    i += k
                    break
            else:
                return None
        return out

    def _exact_long(self, word: str) -> list[int]:
        """Merging one long word: for each rank, the least first, all its places from left to right.

        A merge makes no pair of a lesser rank, so a rank is done when its places are.
        """
        known, size, pairs = self._ids, self._size, self._pairs
        token = [i for x in self._symbols(word) if (i := known.get(x)) is not None]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        flat = np.array(token, np.int64)
        rank = self._pair_rank(flat[:-1], flat[1:])
        order = np.argsort(rank, kind="stable")
        order = order[rank[order] < _NEVER]
        found, begin = np.unique(rank[order], return_index=True)
        places = {int(r): p.tolist() for r, p in zip(found, np.split(order, begin[1:]), strict=True)} if len(found) else {}
        todo = list(places)
        heapq.heapify(todo)
        left, right, made = self.left, self.right, self._made
        while todo:
            r = heapq.heappop(todo)
            z = int(made[r])
            x, y = int(left[z]), int(right[z])
            for i in sorted(places.pop(r)):
                j = after[i]
                if token[i] != x or j >= n or token[j] != y:
                    continue
                k, h = after[j], before[i]
                token[i], token[j], after[i] = z, -1, k
                if k < n:
                    before[k] = i
                    new = pairs.get(z * size + token[k])
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(todo, new)
                        places[new].append(i)
                if h >= 0:
                    new = pairs.get(token[h] * size + z)
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(todo, new)
                        places[new].append(h)
        return [t for t in token if t >= 0]

    def _exact(self, words: list[str]) -> list[list[int]]:
        """Merging in order of rank, the leftmost first; one merge of every word in each round."""
        known = self._ids
        long = {k: self._exact_long(w) for k, w in enumerate(words) if len(w) > LONG_WORD}
        made = [long[k][:1] if k in long else [i for x in self._symbols(w) if (i := known.get(x)) is not None] for k, w in enumerate(words)]
        out = [long.get(k, m) if len(m) < 2 else [] for k, m in enumerate(made)]
        flat = np.array([i for m in made if len(m) > 1 for i in m], np.int64)
        owner = np.repeat(np.array([k for k, m in enumerate(made) if len(m) > 1], np.int64), [len(m) for m in made if len(m) > 1])
        while len(flat):
            rank = np.append(self._pair_rank(flat[:-1], flat[1:]), _NEVER)
            rank[:-1][owner[1:] != owner[:-1]] = _NEVER
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            over = least == _NEVER
            for i, t in zip(owner[over].tolist(), flat[over].tolist(), strict=True):
                out[i].append(t)
            hit = np.flatnonzero(~over & (rank == least))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit
            flat[hit] = self._made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            flat, owner = flat[keep], owner[keep]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, in the byte-level alphabet."""
        guess = [self._greedy(w) for w in words]
        flat = np.array([t for g in guess for t in g or ()], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g or ()) for g in guess])
        border = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.array([g is None for g in guess], bool)
        pairs, back = np.unique(flat[border] * self._size + flat[border + 1], return_inverse=True)
        good = self._compatible(pairs // self._size, pairs % self._size)[back]
        failed[owner[border[~good]]] = True
        self.guesses += len(words)
        self.merged += int(failed.sum())
        for k, ids in zip(np.flatnonzero(failed), self._exact([words[k] for k in np.flatnonzero(failed)]), strict=True):
            guess[k] = ids
        return guess

    def _cut_words(self, stretch: str) -> list[str]:
        """Words in the byte-level alphabet.  Stretches of Latin letters and ASCII marks need no library:
        normalising is lower-casing there, and words are runs of letters or of marks."""
        if _SIMPLE.fullmatch(stretch):
            runs = _RUNS.findall(stretch.lower())
            return runs if stretch.isascii() else [r if r.isascii() else "".join([_BYTES[b] for b in r.encode()]) for r in runs]
        library = self._library
        return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(stretch))]

    def _learn(self, stretches: list[str]) -> None:
        cut = [self._cut_words(s) for s in stretches]
        new = list({w for ws in cut for w in ws if w not in self._words})
        self._words.update(zip(new, self.encode_words(new), strict=True))
        for s, ws in zip(stretches, cut, strict=True):
            ids = [i for w in ws for i in self._words[w]]
            self._store[s] = (np.array(ids, "<u4").tobytes(), "".join(" " + self.text_of[i] for i in ids))
        self.held += ENTRY_BYTES * len(stretches) + 8 * sum(map(len, stretches)) + 24 * sum(len(self._words[w]) for w in new)

    def _age(self) -> None:
        """Begins a new generation."""
        self._old, self._store, self._words, self.held = self._store, {}, {}, 0
        for s, i in self._special.items():
            self._store[s] = (np.array([i], "<u4").tobytes(), " " + s)

    def _stretches(self, text: str) -> list[str]:
        """White-space-free stretches; a special string is one of its own."""
        if "<|" not in text or not self._cut.search(text):
            parts, special = [text], []
        else:
            parts, special = self._cut.split(text), self._cut.findall(text)
        out: list[str] = []
        for k, p in enumerate(parts):
            out += p.split() if p.isascii() and not _PLAIN.search(p) else [s for s in _SPACES.split(p) if s]
            if k < len(special):
                out.append(special[k])
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        lo = 0
        while len(text) - lo > PIECE and not self._whole and (gap := _GAP.search(text, lo + PIECE)):
            yield text[lo : gap.start()]
            lo = gap.end()
        yield text[lo:] if lo else text

    def parts(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """(number of the text, ids as little-endian 32-bit integers, decoded text with a blank before each token) of consecutive pieces."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in self._pieces(text) if text else ():
                held.append((k, self._stretches(piece)))
                size += len(piece)
                if size >= PIECE:
                    yield from self._encoded(held)
                    held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes, str]]:
        if not self._store or self.held > STORE_BYTES // 2:
            self._age()
        new = []
        for s in {s for _, ss in held for s in ss if s not in self._store}:
            if (known := self._old.get(s)) is None:
                new.append(s)
            else:
                self._store[s] = known
                self.held += ENTRY_BYTES // 2 + 8 * len(s)
        self._learn(new)
        for k, ss in held:
            found = [self._store[s] for s in ss]
            yield k, b"".join([f[0] for f in found]), "".join([f[1] for f in found])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian 32-bit integers, and the decoded text."""
        ids: list[list[bytes]] = [[] for _ in texts]
        decoded: list[list[str]] = [[] for _ in texts]
        for k, i, t in self.parts(texts):
            ids[k].append(i)
            decoded[k].append(t)
        return [(b"".join(i), "".join(t)[1:]) for i, t in zip(ids, decoded, strict=True)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, and the digests of what ``encode`` gives; no long text's ids are held together."""
        count, begun = [0] * len(texts), [False] * len(texts)
        ids, decoded = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for k, i, t in self.parts(texts):
            count[k] += len(i) // 4
            ids[k].update(i)
            decoded[k].update((t if begun[k] else t[1:]).encode())
            begun[k] |= bool(t)
        return [(n, i.hexdigest(), t.hexdigest()) for n, i, t in zip(count, ids, decoded, strict=True)]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of at most ``SLICE_ROWS`` rows and, but for longer texts, ``SLICE_BYTES``."""
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > lo and (size + n > SLICE_BYTES or i - lo == SLICE_ROWS):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(column):
        yield lo, len(column)


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), values: bool = False) -> DataFrame:
    """``keep``, n_tokens and both digests for every row; with ``values`` also the ids and the decoded text."""
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    extra = ", ids array<int>, decoded string" if values else ""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = SpeculativeBPE(path)
        for batch in batches:
            for lo, hi in _slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                columns, names = [part.column(c) for c in keep], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                found = coder.digests(texts)
                columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                if values:
                    whole = coder.encode(texts)
                    columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in whole], pa.list_(pa.int32())), pa.array([t for _, t in whole], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return kept.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
