"""What the encoder keeps is bounded in bytes, whatever the texts, and pieces change nothing."""

import random
import string
import subprocess
import sys

from tidemark.llm import bpe
from tidemark.llm.queries import WORD_BPE, tokenizer_path

MEASURE = """
import random, resource, string, sys
from tidemark.llm import bpe
from tidemark.llm.queries import WORD_BPE, tokenizer_path
coder = bpe.SpeculativeBPE(tokenizer_path(WORD_BPE))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = random.Random(1)
words = lambda n: " ".join("".join(r.choices(string.ascii_lowercase, k=9)) for _ in range(n))
for texts in ([words(10_000) for _ in range(100)], [words(1_000_000)]):
    for k in range(0, len(texts), 20):
        coder.digests(texts[k : k + 20])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_distinct_words_stay_under_400_mb():
    """20 MB of words that occur once: 100 texts of 100 kB, and one of 10 MB."""
    done = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, timeout=900, check=True)
    assert int(done.stdout) < 400


def test_pieces_and_forgetting_change_nothing(monkeypatch):
    coder = bpe.SpeculativeBPE(tokenizer_path(WORD_BPE))
    r = random.Random(2)
    specials = list(coder._special)[:3]
    word = lambda: r.choice([*specials, "Hello,", "naïve", "x" * 70, "12,5", "日本", "".join(r.choices(string.ascii_letters, k=7))])
    texts = ["".join(word() + r.choice([" ", "\n", " ", "  ", ""]) for _ in range(r.choice([1, 5, 400]))) for _ in range(30)] + [None, "", "   ", " \n a", "a" * 5000]
    want = [coder._library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for piece, held in ((1 << 18, 1 << 30), (1, 1), (40, 5000)):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "STORE_BYTES", held)
        again = bpe.SpeculativeBPE(tokenizer_path(WORD_BPE))
        found = again.encode(texts)
        assert [list(memoryview(i).cast("I")) for i, _ in found] == want
        import hashlib

        assert again.digests(texts) == [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in found]
