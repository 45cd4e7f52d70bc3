"""The quality rules' verdict against a plain computation, with nulls, ties and repeated rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemark.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def classes(text):
    import unicodedata

    out = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        k = 0 if kind == "Ll" else 1 if kind in ("Lu", "Lt") else 2 if kind == "Nd" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 5
        out[k] += 1
    return out


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocabulary = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(120)] for k, letters in (("en", "abcdefgh"), ("de", "ijklmnopq"))}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = [vocabulary[lang][min(int(r.expovariate(0.05)), 119)] for _ in range(r.choice([10, 60, 150, 300]))]
        out.append((i, " ".join(words).capitalize() + ".", lang, f"s{i % 3}", 1))
    out += [(100, " ".join(str(r.randint(0, 10**6)) for _ in range(200)), "en", "s0", 1), (101, "#$ %& " * 120, "de", "s1", 1), (102, "ab cd " * 100, "en", "s1", 1)]
    base = out[3][1] if len(WORD.findall(out[3][1])) > 60 else " ".join(vocabulary["en"])
    out += [(200, base, "en", None, 1), (201, base + " more", "en", "s1", 1), (None, base + " else", "en", "s2", 1), (202, base, None, "s2", 1), (202, " ".join(reversed(vocabulary["de"])), "de", "s2", 1)]
    return out + [out[5]] * 3 + [(300, None, "en", "s0", None), (301, "", None, None, 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_verdict(docs, rows):
    by_lang, words = {}, {}
    for _, text, lang, _, _ in rows:
        by_lang[lang] = [a + b for a, b in zip(by_lang.get(lang, [0] * 6), classes(text or ""), strict=True)]
        words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
    found = docs.select("*", F.monotonically_increasing_id().alias("size")).transform(lambda d: rules.judge(d, keep=("text", "size"))).collect()
    assert len(found) == len(rows)
    seen = Counter()
    for f in found:
        text, lang = f["text"] or "", f["lang"]
        own = WORD.findall(text)
        far = False
        if len(text) >= rules.MIN_CLASS_CHARS:
            d = distance(classes(text), by_lang[lang])
            assert math.isclose(d, f["class_distance"], abs_tol=1e-9)
            far |= d > rules.MAX_CLASS_DISTANCE
        else:
            assert f["class_distance"] is None
        if len(own) >= rules.MIN_COMMON_WORDS:
            common = [w for w, _ in sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]]
            mine, all_ = Counter(w.lower() for w in own), words[lang]
            p, q = [mine[w] for w in common], [all_[w] for w in common]
            d = distance([*p, len(own) - sum(p)], [*q, sum(all_.values()) - sum(q)])
            assert math.isclose(d, f["word_distance"], abs_tol=1e-9)
            far |= d > rules.MAX_WORD_DISTANCE
        else:
            assert f["word_distance"] is None
        assert f["kept"] == (not f["base_failed"] and not far)
        seen[f["kept"], far] += 1
    assert seen[True, False] and seen[False, True]
