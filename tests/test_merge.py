"""Merged shapes against the rules by recursion over trees."""

import random

from tidemark.operators import merge, model, trees

NAMES = [c.split()[0] for c in model.VARIANTS.split(", ")]


def one_of(r, depth, seen):
    kind = r.choice(["p", "p", "null", "unknown", "o", "o", "a", "r", "u"] if depth < 3 else ["p", "null", "unknown"])
    if kind == "p":
        p = {"kind": "primitive", "type": r.choice(["string", "integer", "number", "boolean"])}
        if p["type"] == "string" and r.random() < 0.5:
            p["formats"] = r.sample(["uuid", "date", "email"], r.randint(1, 2))
        elif p["type"] == "string" and r.random() < 0.5:
            p["enum"] = ["x", "y"]
        return p
    if kind == "o":
        fields = {k: {"shape": one_of(r, depth + 1, seen), "optional": r.random() < 0.3, "seen": r.randint(1, 9) if seen else None} for k in r.sample("abcd", r.randint(0, 3))}
        return {"kind": "object", "fields": fields, "samples": r.randint(9, 20) if seen else None}
    if kind == "a":
        return {"kind": "array", "element": one_of(r, depth + 1, seen) if r.random() < 0.8 else None}
    if kind == "r":
        return {"kind": "record", "value": one_of(r, depth + 1, seen)}
    if kind == "u":
        parts, families = [], set()
        for _ in range(r.randint(2, 3)):
            s = one_of(r, 3 if depth > 1 else depth + 1, seen)
            if s["kind"] not in ("union", "unknown") and family(s) not in families:
                families.add(family(s))
                parts.append(s)
        return {"kind": "union", "variants": parts} if len(parts) > 1 else parts[0] if parts else {"kind": "unknown"}
    return {"kind": kind}


def family(s):
    return "object" if s["kind"] in ("object", "record") else s["kind"] if s["kind"] != "primitive" else "num" if s["type"] in ("integer", "number") else s["type"]


def add(x, y):
    return None if x is None and y is None else (1 if x is None else x) + (1 if y is None else y)


def plain(a, b):
    if a["kind"] == "unknown":
        return b
    if b["kind"] == "unknown":
        return a
    out = []
    for s in [*(a["variants"] if a["kind"] == "union" else [a]), *(b["variants"] if b["kind"] == "union" else [b])]:
        for k, o in enumerate(out):
            if family(o) == family(s):
                out[k] = pair(o, s)
                break
        else:
            out.append(s)
    return out[0] if len(out) == 1 else {"kind": "union", "variants": out}


def pair(a, b):
    if a["kind"] == "primitive":
        s = {"kind": "primitive", "type": a["type"] if a["type"] == b["type"] else "number"}
        both = [f for f in a.get("formats", ()) if f in b.get("formats", ())]
        return s | ({"formats": both} if both else {})
    if a["kind"] == "array":
        return {"kind": "array", "element": plain(a["element"], b["element"]) if a["element"] and b["element"] else a["element"] or b["element"]}
    if a["kind"] == b["kind"] == "record":
        return {"kind": "record", "value": plain(a["value"], b["value"])}
    if a["kind"] == "null":
        return a
    fields = {}
    fa, fb = a.get("fields", {}), b.get("fields", {})
    for k in [*fa, *[k for k in fb if k not in fa]]:
        if k in fa and k in fb:
            fields[k] = {"shape": plain(fa[k]["shape"], fb[k]["shape"]), "optional": fa[k]["optional"] or fb[k]["optional"], "seen": add(fa[k]["seen"], fb[k]["seen"])}
        else:
            fields[k] = (fa.get(k) or fb.get(k)) | {"optional": True}
    return {"kind": "object", "fields": fields, "samples": add(a.get("samples"), b.get("samples"))}


def counted(s):
    """A tree with its counts and orders as plain values, for comparison."""
    if s is None:
        return None
    if s["kind"] == "object":
        return ("object", s["samples"], [(k, bool(f["optional"]), f["seen"], counted(f["shape"])) for k, f in s["fields"].items()])
    if s["kind"] == "union":
        return ("union", [counted(v) for v in s["variants"]])
    if s["kind"] in ("array", "record"):
        return (s["kind"], counted(s.get("element") or s.get("value")))
    return (s["kind"], s.get("type"), s.get("formats") or None, s.get("enum"))


def test_merge(spark):
    r = random.Random(8)
    cases = [(one_of(r, 0, r.random() < 0.7), one_of(r, 0, r.random() < 0.7)) for _ in range(250)]
    sides = [spark.createDataFrame([(f"GET /{k}", "response", 200, *row) for k, c in enumerate(cases) for row in trees.flat(c[side])], model.VARIANTS) for side in (0, 1)]
    assert sides[0].columns == NAMES
    by = {}
    for row in merge.variants(*sides).collect():
        by.setdefault(int(row["endpoint"][5:]), []).append(row.asDict())
    for k, (a, b) in enumerate(cases):
        assert counted(trees.build(by[k])[""]["shape"]) == counted(plain(a, b)), (a, b)
