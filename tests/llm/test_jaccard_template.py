"""Documents that share a template and no more, with and without true copies among them, against brute force; rows that move grow with the documents."""

import random

import numpy as np
import pytest
from tidemark.llm import jaccard_join
from test_jaccard_groups import SCHEMA, components, near, shingles


def templated(r, n, own=14, shared=86):
    """Texts of which 86 % is one template and the rest their own: every two of them have about 0.75 in common."""
    template = [f"t{i}" for i in range(shared * 4)]
    return [" ".join(template + [f"o{r.randrange(10**9)}" for _ in range(own * 4)]) for _ in range(n)]


@pytest.mark.parametrize(("n", "copies"), [(180, 30)])
def test_templates_with_copies(spark, monkeypatch, n, copies):
    monkeypatch.setattr(jaccard_join, "HOT", 64)
    monkeypatch.setattr(jaccard_join, "BITS_BLOCK", 100)
    r = random.Random(4)
    texts = templated(r, n)
    texts += [near(r, r.choice(texts), r.choice([0, 1, 3])) for _ in range(copies)]
    r.shuffle(texts)
    want = components([shingles(t) for t in texts])
    found = {f["doc_id"]: f["component_id"] for f in jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)).collect()}
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_rows_grow_with_the_documents(spark, monkeypatch):
    """Rows dealt to tiles with their shingles: none here; with sizes and bitmaps: one a document and block."""
    dealt = {}
    plain = jaccard_join._tiles

    def counted(members, percent, block, block_shingles):
        found = plain(members, percent, block, block_shingles)
        dealt.setdefault(block, []).append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "_tiles", counted)
    for n in (2500,):
        dealt.clear()
        texts = templated(random.Random(n), n)
        found = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(8))
        assert found.where("doc_id = component_id").count() == n
        assert sum(dealt[jaccard_join.BLOCK]) == 0 and sum(dealt[jaccard_join.BITS_BLOCK]) <= 3 * n


def test_near_by_bits():
    r = np.random.default_rng(3)
    for _ in range(40):
        k = int(r.integers(2, 40))
        base = r.integers(0, 2**64, (4, 400), dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[r.integers(4)][: r.integers(50, r.choice([90, 400]))], r.integers(0, 2**64, int(r.integers(0, 60)), dtype=np.uint64)])) for _ in range(k)]
        sizes = np.array([len(s) for s in sets])
        bits = jaccard_join._wide_bitmaps(np.concatenate(sets), np.append(0, np.cumsum(sizes)))
        root = list(range(k))
        for a, b in jaccard_join.near_by_bits(np.arange(k), sizes, bits, 80):
            root = [root[a] if x == root[b] else x for x in root]
        for i in range(k):
            for j in range(i):
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                    assert root[i] == root[j]
