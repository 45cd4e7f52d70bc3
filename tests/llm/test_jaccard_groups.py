"""Large groups of near copies, several of them in one cluster, shared and null ids, against brute force."""

import random

import pytest
from tidemark.llm import jaccard_join

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near(r, base, changes):
    w = base.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("block", "leaders", "pairs_up_to"), [(128, 3, 64), (8, 3, 4), (8, 1, 4), (20, 2, 64)])
def test_groups(spark, monkeypatch, block, leaders, pairs_up_to):
    for name, value in (("BLOCK", block), ("LEADERS", leaders), ("PAIRS_UP_TO", pairs_up_to), ("HOT", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(block)
    bases = [" ".join(f"w{r.randrange(400)}" for _ in range(n)) for n in (60, 60, 90, 200)]
    bases[1] = bases[0][: len(bases[0]) * 2 // 3] + " " + bases[1]  # two groups that share a passage
    texts = [near(r, bases[k % 4], r.choice([0, 1, 1, 2, 4])) for k in range(240)] + [bases[0]] * 5 + [None, "", "a b"]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    want = components([shingles(t) for t in texts])
    found = {f["doc_id"]: f["component_id"] for f in jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_shared_and_null_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "q w e r t z u i o p"
    rows = [(5, a), (5, b), (6, a), (7, b), (None, a), (None, "alone in the world of many words"), (None, None), (8, a), (8, a)]
    found = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(5, 6, 5), (5, 6, 5), (6, 6, 5), (7, 6, 5), (None, 6, 5), (None, 3, None), (None, 0, None), (8, 6, 5), (8, 6, 5)]
    assert found == sorted(want, key=str)
