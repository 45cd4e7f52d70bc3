"""Bodies too long to be held as values: read in pieces, with the places that a whole reading gives."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from tidemark.operators import model, shapes

BODIES = "endpoint string, status int, ord long, body string"


def batch(*texts):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"endpoint": ["GET /x"] * n, "slot": ["response"] * n, "status": [200] * n, "ord": list(range(n)), "body": list(texts)})


def added(batches):
    """Places of all batches, added up as the tables do it."""
    out = {}
    for row in (r for b in batches for r in b.to_pylist()):
        at = out.setdefault((row["path"], row["parent"], row["key"], row["depth"], row["family"]), {"n": 0, "whole": True, "mask": -1, "first": (1 << 60, 0), "vals": {}, "open": False})
        at["n"] += row["n"]
        at["whole"] &= row["all_int"] is not False
        at["mask"] &= -1 if row["fmt_mask"] is None else row["fmt_mask"]
        at["first"] = min(at["first"], (row["first_ord"], row["first_pos"]))
        at["open"] |= row["open"]
        for v in row["vals"] or []:
            n, first = at["vals"].get(v["v"], (0, (1 << 60, 0)))
            at["vals"][v["v"]] = n + v["n"], min(first, (v["ord"], v["pos"]))
    return {k: v | ({"vals": None, "open": True} if v["open"] or len(v["vals"]) > shapes.ENUM_MAX else {}) for k, v in out.items()}


def text(r, depth):
    white = lambda: r.choice(["", "", "", " ", "\n\t"])
    key = lambda: json.dumps(r.choice([str(r.randrange(30)), "k%d" % r.randrange(40), "007", "4294967295", "é", "x,y", 'q"{', "\ud800", ""]))
    some = range(r.choice([0, 1, 3, 12]))
    kind = r.randrange(10)
    if depth and kind < 4:
        return "{" + white() + ",".join(f"{white()}{key()}{white()}:{white()}{text(r, depth - 1)}{white()}" for _ in some) + "}"
    if depth and kind < 8:
        return "[" + white() + ",".join(f"{white()}{text(r, depth - 1)}{white()}" for _ in some) + "]"
    return r.choice(["1", "-0.5e3", "1.0", "true", "null", '"a"', f'"t{r.randrange(12)}"', '"2024-01-05"', '"long ' + "z" * r.randrange(99) + '"', '"\\u00e9, ]"', "1" * 30, "9" * 5000, "NaN"][: 13 if r.random() < 0.02 else 11])


def test_pieces_give_what_the_whole_gives(monkeypatch):
    """Equal keys, index-like keys, nested long members, and texts that end early or go on; every window and piece size cuts elsewhere."""
    r = random.Random(4)
    for _ in range(200):
        body = text(r, 3)
        if r.random() < 0.2:
            at = r.randrange(len(body))
            body = body[:at] + r.choice(["", ",", "]", "}", '"', "x", "{"]) + body[at + r.randrange(2) :]
        with monkeypatch.context() as m:
            m.setattr(shapes, "LONG", 1 << 30)
            whole = added(shapes.walked_batches([batch(body, "[1]")]))
        with monkeypatch.context() as m:
            for name, most in (("LONG", 0), ("PIECE", r.choice([1, 2, 7, 30, 200])), ("HELD", r.choice([0, 3000, 1 << 30]))):
                m.setattr(shapes, name, most)
            assert added(shapes.walked_batches([batch(body, "[1]")])) == whole, body[:500]


@pytest.mark.parametrize("bodies", [1, 400])
def test_memory_does_not_follow_the_places(bodies):
    """40,000 keys in one body, and the same keys in bodies that aren't long: what a task holds is bounded."""
    n = 40_000 // bodies
    texts = ["{" + ",".join(f'"o{i}":{{"status":"{"FOP"[i % 3]}","lines":[{i % 7}]}}' for i in range(b * n, b * n + n)) + "}" for b in range(bodies)]
    given, rows = batch(*texts), 0
    del texts
    tracemalloc.start()
    for found in shapes.walked_batches(iter([given])):
        rows += found.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 160_001 and peak < 80 << 20


def test_a_long_body_in_the_model(spark):
    """A long dictionary collapses as a short one does, beside a body that isn't read for its end."""
    entries = ",".join(f'"o{i}":{{"status":"{"FOP"[i % 3]}","lines":[{i % 7}]}}' for i in range(10_000))
    bodies = spark.createDataFrame([("GET /x", 200, 0, "{" + entries + "}"), ("GET /x", 200, 1, "{" + entries + ",}"), ("GET /x", 200, 2, '{"o1":{"status":"X","lines":[1]}}')], BODIES)
    assert len(entries) > shapes.LONG
    found = model.observed(shapes.observe(bodies)).select(shapes.shown("path").alias("path"), "kind", "type", "enum").collect()
    assert sorted((f["path"], f["kind"], f["type"], f["enum"]) for f in found) == [
        ("$", "record", None, None), ("${}", "object", None, None), ("${}.lines", "array", None, None), ("${}.lines[]", "primitive", "integer", None), ("${}.status", "primitive", "string", ["F", "O", "P", "X"]),
    ]


def test_dictionaries_at_several_levels(spark, monkeypatch):
    """Dictionaries in dictionaries: each level is looked up by itself, here in plans of its own."""
    monkeypatch.setattr(model, "LEVELS", 1)
    inner = {f"k{i}": 1.5 for i in range(12)}
    body = {"a": {f"k{i}": {"x": {f"k{j}": inner for j in range(12)}} for i in range(12)}, "b": inner}
    found = model.observed(shapes.observe(spark.createDataFrame([("GET /x", 200, 0, json.dumps(body))], BODIES))).select(shapes.shown("path").alias("path"), "kind").collect()
    assert sorted(map(tuple, found)) == [
        ("$", "object"), ("$.a", "record"), ("$.a{}", "object"), ("$.a{}.x", "record"), ("$.a{}.x{}", "record"), ("$.a{}.x{}{}", "primitive"), ("$.b", "record"), ("$.b{}", "primitive"),
    ]
