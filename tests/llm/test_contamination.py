"""Occurrences of benchmark windows against a plain search over lists of words."""

import hashlib
import random
import re

import pytest
from parity import compare, connect
from tidemark.llm import contamination as C
from tidemark.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in patterns:
                    hit.update(range(i, i + m))
                    found |= patterns[p]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((str(doc), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_equals_sql(spark):
    df = QUERIES["op13_contamination"](spark, "/root/testdata/sf0.001")
    assert compare(connect("/root/testdata/sf0.001"), df, ORACLE_SQL["op13_contamination"]) == ""
    assert df.where("contaminated").count() > 0 and df.where("not contaminated").count() > 100


@pytest.fixture(scope="module")
def tables():
    r = random.Random(6)
    vocabulary = ["a", "b", "ab", "Ä", "ä", "x1", "\u0085y", "ﬂ", "É", "wort", "WORT"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", ", ", "  ", "\x00", "\x7f"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 9, 10, 11, 14, 30]) if i % 3 else 25)) for i in range(40)]
    items += [(100, None), (101, ""), (102, "-- .. !"), (None, text(12)), (7, text(13)), (103, "a a a a a a a a a a a a"), (104, items[0][1]), (105, "longer thing " * 8)]
    docs = [(i, text(r.choice([0, 1, 3, 9, 10, 40, 200]))) for i in range(60)]
    for i in range(60):
        source = r.choice(items)[1] or ""
        docs.append((100 + i, text(r.randint(0, 20)) + " " + source.upper().replace(" ", " ... ") + " " + text(r.randint(0, 300))))
    docs += [(300, None), (301, ""), (302, "!?"), (None, docs[3][1]), (303, "a " * 3000)] + [docs[100]] * 25
    return docs, items


def test_odd_texts(spark, tables):
    docs, items = tables
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", item_id string, n_hit int").repartition(5)
    right = spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS + ", doc_id int")
    assert found(C.search(left, right)) == brute(docs, items)


def test_several_blocks(spark, tables):
    docs, items = tables
    left, right = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    assert found(C.search(left, right, size=40)) == brute(docs, items)


def test_pieces(spark, tables, monkeypatch):
    docs, items = tables
    matcher = C.Matcher([(None if i is None else str(i), " ".join(words(t)[k : k + 10])) for i, t in items if words(t) for k in range(max(1, len(words(t)) - 9))])
    import pyarrow as pa

    whole = [(hit.tolist(), found) for hit, found in matcher.texts(pa.array([t for _, t in docs]))]
    for piece in (1, 7, 64):
        monkeypatch.setattr(C, "PIECE", piece)
        assert [(hit.tolist(), found) for hit, found in matcher.texts(pa.array([t for _, t in docs]))] == whole


def test_empty(spark):
    docs = [(1, "one two three"), (2, None)]
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)
    assert found(C.search(some, none)) == brute(docs, [])
    assert found(C.search(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "one")], ITEMS))) == []
    assert found(C.search(some, spark.createDataFrame([(1, None), (2, " ")], ITEMS))) == brute(docs, [])


def test_skips():
    """Texts without a word pair of the benchmark are passed in steps of nine words."""
    import numpy as np

    group = C.Matcher([("1", " ".join(f"w{i}" for i in range(10)))]).groups[0]
    assert group.shift.max() == 9 and (group.shift < 9).sum() <= 9
    assert np.flatnonzero(group.shift == 0).size == 1
