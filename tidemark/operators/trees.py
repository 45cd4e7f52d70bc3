"""One shape as a tree, put together from its variants' rows, and its texts.

A shape is a dict with ``kind``; ``object`` has ``fields`` (name to shape, optional, seen), ``array`` ``element``, ``record``
``value``, ``union`` ``variants``, ``primitive`` ``type`` and perhaps ``formats`` and ``enum``.  A shape's rows are as
many as its distinct places.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd

SEP = "\x1f"
_PLAIN_KEY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
STEP = "  "


def rows_of(pdf: pd.DataFrame) -> list[dict]:
    """Rows with nulls as None and lists as lists."""

    def plain(x):
        if x is None or isinstance(x, float) and x != x or x is pd.NA:
            return None
        return list(x) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else x

    return [{k: plain(v) for k, v in r.items()} for r in pdf.to_dict("records")]


def build(rows: list[dict]) -> dict:
    """Every place's shape by path; the root's is at the empty path."""
    at, below = defaultdict(list), defaultdict(set)
    for r in rows:
        at[r["path"]].append(r)
        if r["parent"] is not None:
            below[r["parent"]].add(r["path"])
    done: dict[str, dict] = {}
    for path in sorted(at, key=lambda p: -p.count(SEP)):
        here = [(_variant(r, path + (f"{SEP}|{r['copy']}" if r["copy"] else ""), at, below, done), r) for r in sorted(at[path], key=lambda r: r["variant"])]
        shape = here[0][0] if len(here) == 1 else {"kind": "union", "variants": [s for s, _ in here]}
        done[path] = {"shape": shape, "variants": [(s, int(r["variant"])) for s, r in here]}
    return done


def _variant(r: dict, base: str, at: dict, below: dict, done: dict) -> dict:
    kind = r["kind"]
    if kind == "object":
        inner = sorted((at[p][0] for p in below[base] if at[p][0]["key"] is not None), key=lambda x: x["place"])
        fields = {x["key"]: {"shape": done[x["path"]]["shape"], "optional": bool(x["optional"]), "seen": x["seen"]} for x in inner}
        return {"kind": kind, "fields": fields, "samples": r["samples"]}
    if kind == "array":
        return {"kind": kind, "element": done[base + SEP + "[]"]["shape"] if base + SEP + "[]" in done else None}
    if kind == "record":
        return {"kind": kind, "value": done[base + SEP + "{}"]["shape"]}
    if kind == "primitive":
        shape = {"kind": kind, "type": r["type"]}
        if r["formats"]:
            shape["formats"] = r["formats"]
        if r["enum"]:
            shape["enum"] = [_literal(v, r["type"]) for v in r["enum"]]
        return shape
    return {"kind": kind}


def _literal(value: str, type_: str):
    return value if type_ == "string" else int(value) if re.fullmatch(r"-?\d+", value) else float(value)


def flat(shape: dict, path: str = "", parent: str | None = None, key: str | None = None, place: int = 0, optional: bool = False, seen: int | None = None) -> Iterator[tuple]:
    """A tree as the columns path to copy of variants' rows; a union's second object or array is told apart by ``copy``."""
    met: dict[tuple, int] = defaultdict(int)
    for number, v in enumerate(shape["variants"] if shape["kind"] == "union" else [shape]):
        slot = (v["kind"], v.get("type"))
        copy, met[slot] = met[slot], met[slot] + 1
        enum = [x if isinstance(x, str) else json.dumps(x) for x in v["enum"]] if v.get("enum") else None
        yield path, parent, key, v["kind"], v.get("type"), v.get("formats"), enum, v.get("samples"), seen, optional, place, number, copy
        base = path + (f"{SEP}|{copy}" if copy else "")
        if v["kind"] == "object":
            for k, (name, f) in enumerate(v["fields"].items()):
                yield from flat(f["shape"], f"{base}{SEP}.{name}", base, name, k, f["optional"], f.get("seen"))
        elif v["kind"] == "array" and v["element"] is not None:
            yield from flat(v["element"], f"{base}{SEP}[]", base)
        elif v["kind"] == "record":
            yield from flat(v["value"], base + SEP + "{}", base)


def prop(name: str) -> str:
    """An object's key, quoted where it must be."""
    return name if _PLAIN_KEY.fullmatch(name) else json.dumps(name, ensure_ascii=False)


def _literals(values: list) -> str:
    return " | ".join(json.dumps(v, ensure_ascii=False) for v in values)


def members(shape: dict, depth: int) -> list[str]:
    """An object's members as lines at ``depth``."""
    out = []
    for name, f in shape["fields"].items():
        doc = f"/** format: {', '.join(f['shape']['formats'])} */ " if f["shape"].get("formats") else ""
        out.append(f"{STEP * depth}{doc}{prop(name)}{'?' * f['optional']}: {ts(f['shape'], depth)};")
    return out


def _ts_object(shape: dict, depth: int) -> str:
    lines = "\n".join(members(shape, depth + 1))
    return "{\n" + lines + "\n" + STEP * depth + "}" if lines else "Record<string, never>"


def _ts_array(shape: dict, depth: int) -> str:
    inner = shape["element"] or {"kind": "unknown"}
    text = ts(inner, depth)
    return f"Array<{text}>" if inner["kind"] == "union" or len(inner.get("enum", ())) > 1 else text + "[]"


_TS: dict[str, Callable[[dict, int], str]] = {
    "object": _ts_object,
    "array": _ts_array,
    "record": lambda s, d: f"Record<string, {ts(s['value'], d)}>",
    "union": lambda s, d: " | ".join(ts(v, d) for v in s["variants"]) or "never",
    "primitive": lambda s, d: _literals(s["enum"]) if s.get("enum") else "number" if s["type"] == "integer" else s["type"],
}


def ts(shape: dict, depth: int = 0) -> str:
    """A shape as a TypeScript type."""
    draw = _TS.get(shape["kind"])
    return draw(shape, depth) if draw else shape["kind"]


# fixed values: the checks of a string schema by format
_CHECKS = {"uuid": ".uuid()", "date-time": ".datetime()", "date": r".regex(/^\d{4}-\d{2}-\d{2}$/)", "email": ".email()", "uri": ".url()"}


def _zod_union(parts: list[dict], depth: int) -> str:
    rest = [v for v in parts if v["kind"] != "null"]
    if len(rest) == 1 and len(rest) < len(parts):
        return zod(rest[0], depth) + ".nullable()"
    if len(parts) == 1:
        return zod(parts[0], depth)
    return "z.union([" + ", ".join(zod(v, depth) for v in parts) + "])" if parts else "z.never()"


def _zod_object(shape: dict, depth: int) -> str:
    lines = "".join(f"{STEP * (depth + 1)}{prop(k)}: {zod(f['shape'], depth + 1)}{'.optional()' * f['optional']},\n" for k, f in shape["fields"].items())
    return "z.object({" + (f"\n{lines}{STEP * depth}" if lines else "") + "})"


def _zod_primitive(shape: dict, depth: int) -> str:
    values = shape.get("enum")
    if values and all(isinstance(v, str) for v in values):
        return "z.enum([" + ", ".join(json.dumps(v, ensure_ascii=False) for v in values) + "])"
    if values:
        each = [f"z.literal({json.dumps(v)})" for v in values]
        return each[0] if len(each) == 1 else f"z.union([{', '.join(each)}])"
    if shape["type"] == "integer":
        return "z.number().int()"
    return f"z.{shape['type']}()" + (_CHECKS[shape["formats"][0]] if shape.get("formats") and shape["type"] == "string" else "")


_ZOD: dict[str, Callable[[dict, int], str]] = {
    "object": _zod_object,
    "array": lambda s, d: f"z.array({zod(s['element'] or {'kind': 'unknown'}, d)})",
    "record": lambda s, d: f"z.record({zod(s['value'], d)})",
    "union": lambda s, d: _zod_union(s["variants"], d),
    "primitive": _zod_primitive,
}


def zod(shape: dict, depth: int = 0) -> str:
    """A shape as a zod schema."""
    draw = _ZOD.get(shape["kind"])
    return draw(shape, depth) if draw else f"z.{shape['kind']}()"


def _schema_primitive(shape: dict) -> dict:
    out = {"type": shape["type"]}
    if shape.get("formats") and shape["type"] == "string":
        out["format"] = shape["formats"][0]
    return out | ({"enum": list(shape["enum"])} if shape.get("enum") else {})


def _schema_union(shape: dict) -> dict:
    rest = [v for v in shape["variants"] if v["kind"] != "null"]
    if len(rest) == 1 and len(rest) < len(shape["variants"]):
        if rest[0]["kind"] == "primitive" and not rest[0].get("enum"):
            plain = _schema_primitive(rest[0])
            return plain | {"type": [plain["type"], "null"]}
        return {"anyOf": [json_schema(rest[0]), {"type": "null"}]}
    return {"anyOf": [json_schema(v) for v in shape["variants"]]}


def _schema_object(shape: dict) -> dict:
    needed = [k for k, f in shape["fields"].items() if not f["optional"]]
    return {"type": "object", "properties": {k: json_schema(f["shape"]) for k, f in shape["fields"].items()}} | ({"required": needed} if needed else {})


_SCHEMA: dict[str, Callable[[dict], dict]] = {
    "object": _schema_object,
    "array": lambda s: {"type": "array", "items": json_schema(s["element"]) if s["element"] else {}},
    "record": lambda s: {"type": "object", "additionalProperties": json_schema(s["value"])},
    "union": _schema_union,
    "primitive": _schema_primitive,
    "null": lambda s: {"type": "null"},
}


def json_schema(shape: dict) -> dict:
    """A shape as JSON Schema."""
    draw = _SCHEMA.get(shape["kind"])
    return draw(shape) if draw else {}


def ddl(shape: dict | None) -> str:
    """A Spark type under which the bodies can be read; unions become strings."""
    kind = shape["kind"] if shape else "unknown"
    if kind == "object":
        return "STRUCT<" + ", ".join(f"`{k}`: {ddl(f['shape'])}" for k, f in shape["fields"].items()) + ">"
    if kind == "array":
        return f"ARRAY<{ddl(shape['element'])}>"
    if kind == "record":
        return f"MAP<STRING, {ddl(shape['value'])}>"
    if kind == "union":
        core = [v for v in shape["variants"] if v["kind"] != "null"]
        return ddl(core[0]) if len(core) == 1 else "STRING"
    return {"integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN"}.get(shape.get("type") if shape else "", "STRING")


def noted(shape: dict) -> str:
    """A type's text; of a primitive also what the text doesn't tell, so a change of it can be seen."""
    if shape["kind"] == "primitive" and shape["type"] == "integer":
        return "number (integer)"
    if shape["kind"] == "primitive" and shape.get("formats") and not shape.get("enum"):
        return f"{ts(shape)} ({', '.join(shape['formats'])})"
    return ts(shape)


def texts(places: dict) -> Iterator[tuple]:
    """(path, variant, text, core_text, whole_text) of every variant of a built shape."""
    for path, found in places.items():
        core = [v for v, _ in found["variants"] if v["kind"] != "null"]
        core_text = noted(core[0]) if len(core) == 1 else noted({"kind": "union", "variants": core}) if core else None
        whole = noted(found["shape"])
        for shape, number in found["variants"]:
            yield path, number, noted(shape), core_text, whole


def equal(a: dict | None, b: dict | None) -> bool:
    """Whether two shapes are the same but for order and counts."""

    def canonical(s):
        if s is None:
            return None
        out = [s["kind"], s.get("type"), sorted(s.get("formats") or ()), sorted(map(str, s.get("enum") or ()))]
        if s["kind"] == "object":
            out.append(sorted((k, f["optional"], canonical(f["shape"])) for k, f in s["fields"].items()))
        elif s["kind"] == "union":
            out.append(sorted((canonical(v) for v in s["variants"]), key=str))
        else:
            out += [canonical(s.get("element")), canonical(s.get("value"))]
        return out

    return json.dumps(canonical(a), sort_keys=True) == json.dumps(canonical(b), sort_keys=True)
