"""Unbroken words of many letters: ids as the library's, in time about proportional to their length."""

import random
import time

import numpy as np
import pytest
from tidemark.llm import bpe
from tidemark.llm.queries import WORD_BPE, tokenizer_path


@pytest.fixture(scope="module")
def coder():
    return bpe.SpeculativeBPE(tokenizer_path(WORD_BPE))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "x", "etaoinéß", "你好世界中国人", "ünd0😀"])
@pytest.mark.parametrize("n", [63, 64, 65, 66, 500, 20_000])
def test_as_the_library(coder, library, letters, n):
    word = "".join(random.Random(n).choice(letters) for _ in range(n))
    text = f"{word} and {word[::-1]}"
    assert np.frombuffer(coder.encode([text])[0][0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_time_grows_with_the_length(coder):
    r = random.Random(1)
    took = []
    for n in (50_000, 400_000):
        word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        coder.encode([word])
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1


def test_long_and_short_merging_agree(coder):
    r = random.Random(2)
    words = ["".join(r.choice("aabcdeghilnorstt") for _ in range(r.randint(2, 60))) for _ in range(500)]
    assert [coder._exact_long(w) for w in words] == coder._exact(words)
