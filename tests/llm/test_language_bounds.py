"""Language identification: cuts and bounds change no prediction; memory stays bounded for large alphabets."""

import random
import tracemalloc

import numpy as np
from tidemark.llm import language_id as L


def brute(text):
    """The bundle of a text, run by run."""
    low, codes = "\n" + text.lower() + "\n", []
    for c in low:
        if c.isalpha():
            codes.append(ord(c))
        elif not codes or codes[-1]:
            codes.append(0)
    vector = lambda c: np.random.default_rng([7, c]).choice(np.array([-1, 1], np.float32), L.DIMENSIONS)
    known = {c: vector(c) for c in set(codes)}
    out = np.zeros(L.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(known[a], 2) * np.roll(known[b], 1) * known[c]
    return out


def texts(r):
    words = ["".join(r.choice("abcdefghijké你好ß") for _ in range(r.randint(1, 9))) for _ in range(50)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(12)] + ["", None, "12 3!", "A", "x--y  z\n"]


def test_bundles_match_brute_force_under_any_bounds(monkeypatch):
    some = texts(random.Random(3))
    want = np.stack([brute(t or "") if t else np.zeros(L.DIMENSIONS) for t in some])
    for slice_bytes, cells, at_once in ((1 << 19, 1 << 21, 4096), (40, 50, 7), (1 << 19, 1, 3), (25, 1 << 21, 4096)):
        for name, value in (("SLICE_BYTES", slice_bytes), ("CELLS", cells), ("RUNS_AT_ONCE", at_once)):
            monkeypatch.setattr(L, name, value)
        found, has = L.bundles(L.Runs(), some, np.arange(len(some)), len(some))
        assert np.array_equal(found[has], want[has]) and has.tolist() == [bool(t) and any(c.isalpha() for c in t) for t in some]


def test_memory_of_many_distinct_runs():
    r = random.Random(1)
    some = ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(40)) for _ in range(2000)]
    tracemalloc.start()
    L.bundles(L.Runs(), some, np.arange(len(some)), len(some))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
