"""What code believes of an API, as a model that drift can compare: claims come as JSON Schema or as Spark types.

A claims map binds endpoints to ``file#Name`` references (a JSON Schema file and a definition in it) or to types given
directly.  What has no honest shape is refused with a reason and never guessed; a refused slot claims nothing, and
an endpoint with every slot refused is left out.  Claims are configuration, so they are read on the driver.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import formats
from . import model as M
from . import trees

MAX_DEPTH = 32
_METADATA = ("optional", "nullable")


class Refusal(ValueError):
    """Why a claim can't be audited."""


@dataclass(frozen=True)
class Claims:
    """A claimed model, and a row (endpoint, slot, ref, reason) for each claim that can't be audited."""

    model: M.Model
    not_auditable: DataFrame


def parse_ref(ref: str) -> tuple[str, str]:
    """File and name of ``file#Name``, parted at the last mark."""
    file, mark, name = ref.rpartition("#")
    if not mark or not file or not name:
        raise Refusal(f'Invalid type reference "{ref}": expected "file#Type".')
    return file, name


def _union(variants: list[dict]) -> dict:
    """Variants as one shape: null last, and a closed set of strings given up where any string is allowed."""
    flat = [x for v in variants for x in (v["variants"] if v["kind"] == "union" else [v])]
    rest, nulls = [v for v in flat if v["kind"] != "null"], [v for v in flat if v["kind"] == "null"]
    open_string = any(v.get("type") == "string" and "enum" not in v for v in rest)
    out: list[dict] = []
    for v in [v for v in rest if not (open_string and v.get("type") == "string" and "enum" in v)] + nulls[:1]:
        if not any(trees.equal(v, o) for o in out):
            out.append(v)
    if not out:
        raise Refusal("A union has no variant that JSON can hold.")
    return out[0] if len(out) == 1 else {"kind": "union", "variants": out}


def literals(values: list) -> dict:
    """A set of literal values: strings sorted, numbers sorted by value, booleans as their type, null last."""
    strings = sorted({v for v in values if isinstance(v, str)})
    numbers = sorted({v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)})
    parts = [{"kind": "primitive", "type": "string", "enum": strings}] if strings else []
    if numbers:
        whole = all(float(n).is_integer() for n in numbers)
        parts.append({"kind": "primitive", "type": "integer" if whole else "number", "enum": [int(n) for n in numbers] if whole else numbers})
    if any(isinstance(v, bool) for v in values):
        parts.append({"kind": "primitive", "type": "boolean"})
    if any(v is None for v in values):
        parts.append({"kind": "null"})
    if any(isinstance(v, (list, dict)) for v in values):
        raise Refusal("A literal array or object has no shape.")
    return _union(parts)


def from_json_schema(schema, definitions: dict | None = None, depth: int = 0, open_refs: tuple[str, ...] = ()) -> dict:
    """Shape of a JSON Schema; ``$ref`` to ``#/$defs/Name`` or ``#/definitions/Name`` is looked up in ``definitions``."""
    if depth > MAX_DEPTH:
        raise Refusal(f"Type nesting exceeds {MAX_DEPTH} levels.")
    go = lambda s, refs=open_refs: from_json_schema(s, definitions, depth + 1, refs)
    if schema is True or schema == {}:
        return {"kind": "unknown"}
    if schema is False or "not" in schema:
        raise Refusal("A schema that forbids everything, or is given by what it is not, describes no JSON value.")
    if "$ref" in schema:
        name = schema["$ref"].rpartition("/")[2]
        if name in open_refs:
            raise Refusal("Recursive type: JSON payloads cannot be cyclic.")
        if name not in (definitions or {}):
            raise Refusal(f'No definition "{name}".')
        return go(definitions[name], (*open_refs, name))
    if "const" in schema or "enum" in schema:
        return literals([schema["const"]] if "const" in schema else schema["enum"])
    for word in ("anyOf", "oneOf"):
        if word in schema:
            return _union([go(s) for s in schema[word]])
    if "allOf" in schema:
        merged: dict = {"type": "object", "properties": {}, "required": []}
        for s in schema["allOf"]:
            while "$ref" in s:
                s = (definitions or {}).get(s["$ref"].rpartition("/")[2]) or {}
            if s.get("type", "object") != "object":
                raise Refusal("Only objects can be intersected.")
            merged["properties"] |= s.get("properties", {})
            merged["required"] += s.get("required", [])
        return go(merged)
    kind = schema.get("type")
    if isinstance(kind, list):
        return _union([go(schema | {"type": k}) for k in kind])
    if kind in ("integer", "number", "boolean"):
        return {"kind": "primitive", "type": kind}
    if kind == "string":
        return {"kind": "primitive", "type": "string"} | ({"formats": [schema["format"]]} if schema.get("format") in formats.NAMES else {})
    if kind == "null":
        return {"kind": "null"}
    if kind == "array":
        tuple_ = schema.get("prefixItems")
        if tuple_:
            return {"kind": "array", "element": _union([go(s) for s in tuple_])}
        items = schema.get("items")
        return {"kind": "array", "element": None if items is None else go(items)}
    if kind == "object" or "properties" in schema:
        return _object(schema, go)
    raise Refusal(f"Unsupported type {json.dumps(kind)}.")


def _object(schema: dict, go) -> dict:
    named, other = schema.get("properties", {}), schema.get("additionalProperties")
    if isinstance(other, dict) and other:
        if named:
            raise Refusal("Named properties together with a type for all others have no shape.")
        return {"kind": "record", "value": go(other)}
    fields = {}
    for name in sorted(named):
        try:
            fields[name] = {"shape": go(named[name]), "optional": name not in schema.get("required", [])}
        except Refusal as reason:
            raise Refusal(f'Property "{name}": {reason}') from None
    return {"kind": "object", "fields": fields, "samples": None}


def from_spark_type(data_type: T.DataType, depth: int = 0) -> dict:
    """Shape of a Spark type.

    A struct field's ``nullable`` can't tell what may be absent from what may be null, so a nullable field must say it in its
    metadata: ``{"optional": true}``, ``{"nullable": true}`` or both; without, the type is refused.
    """
    if depth > MAX_DEPTH:
        raise Refusal(f"Type nesting exceeds {MAX_DEPTH} levels.")
    if isinstance(data_type, T.StructType):
        fields = {}
        for f in sorted(data_type.fields, key=lambda f: f.name):
            if f.nullable and not any(f.metadata.get(k) for k in _METADATA):
                raise Refusal(f'Property "{f.name}": nullable, but its metadata doesn\'t say whether it may be absent or null.')
            try:
                shape = from_spark_type(f.dataType, depth + 1)
            except Refusal as reason:
                raise Refusal(f'Property "{f.name}": {reason}') from None
            if f.metadata.get("enum"):
                shape = literals(f.metadata["enum"])
            fields[f.name] = {"shape": _union([shape, {"kind": "null"}]) if f.metadata.get("nullable") else shape, "optional": bool(f.metadata.get("optional"))}
        return {"kind": "object", "fields": fields, "samples": None}
    if isinstance(data_type, T.ArrayType):
        element = from_spark_type(data_type.elementType, depth + 1)
        return {"kind": "array", "element": _union([element, {"kind": "null"}]) if data_type.containsNull else element}
    if isinstance(data_type, T.MapType):
        if not isinstance(data_type.keyType, T.StringType):
            raise Refusal("A map whose keys aren't strings is no JSON object.")
        value = from_spark_type(data_type.valueType, depth + 1)
        return {"kind": "record", "value": _union([value, {"kind": "null"}]) if data_type.valueContainsNull else value}
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"kind": "primitive", "type": "integer"}
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return {"kind": "primitive", "type": "number"}
    if isinstance(data_type, T.StringType):
        return {"kind": "primitive", "type": "string"}
    if isinstance(data_type, T.BooleanType):
        return {"kind": "primitive", "type": "boolean"}
    if isinstance(data_type, T.NullType):
        return {"kind": "null"}
    if isinstance(data_type, T.VariantType):
        return {"kind": "unknown"}
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise Refusal("A date is no JSON type: the wire carries a string or a number. Claim the transport type instead.")
    raise Refusal(f"{data_type.simpleString()} is not a JSON type.")


def load_map(path: str) -> list[dict]:
    """Entries of a claims map file; ValueError where it isn't one."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError(f"Failed to parse claims map {path}: {error}") from None
    entries = found.get("entries") if isinstance(found, dict) else None
    if not isinstance(entries, list):
        raise ValueError(f'Claims map {path} needs an "entries" array.')
    for k, e in enumerate(entries):
        if not isinstance(e, dict) or not isinstance(e.get("method"), str) or not isinstance(e.get("pattern"), str):
            raise ValueError(f"Claims map {path}: entry {k} needs method and pattern.")
    return entries


def _shape(ref, folder: Path) -> dict:
    if isinstance(ref, T.DataType):
        return from_spark_type(ref)
    if isinstance(ref, dict):
        return from_json_schema(ref, ref.get("$defs") or ref.get("definitions"))
    file, name = parse_ref(ref)
    path = Path(file) if Path(file).is_absolute() else folder / file
    if not path.exists():
        raise Refusal(f"Source file not found: {path}")
    document = json.loads(path.read_text(encoding="utf-8"))
    definitions = document.get("$defs") or document.get("definitions") or {}
    if name not in definitions:
        raise Refusal(f'No definition "{name}" in {path}.')
    return from_json_schema(definitions[name], definitions, open_refs=(name,))


def extract(spark: SparkSession, entries: list[dict], folder: str = ".") -> Claims:
    """The claims of a map's entries: method, pattern, and perhaps status (200), response, request, query.

    Entries of one endpoint are taken together; the first gives request and query.
    """
    grouped: dict[str, list[dict]] = defaultdict(list)
    for e in entries:
        grouped[f"{e['method'].upper()} {e['pattern']}"].append(e)
    ends, responses, variants, refused = [], [], [], []
    for endpoint in sorted(grouped):
        first = grouped[endpoint][0]

        def claim(slot: str, ref, endpoint: str = endpoint) -> dict | None:
            if ref is None:
                return None
            try:
                return _shape(ref, Path(folder))
            except Refusal as reason:
                refused.append((endpoint, slot, ref if isinstance(ref, str) else json.dumps(ref) if isinstance(ref, dict) else ref.simpleString(), str(reason)))
                return None

        found = []
        for e in grouped[endpoint]:
            status = e.get("status") or 200
            shape = claim(f"response[{status}]", e.get("response"))
            if e.get("response") is None or shape is not None:
                found.append((status, shape))
        others = {slot: claim(slot, first.get(slot)) for slot in ("request", "query")}
        if not found and not any(others.values()):
            continue
        method, pattern = first["method"].upper(), first["pattern"]
        ends.append((endpoint, method, pattern, 0, None, *names(method, pattern)))
        for status, shape in {s: x for s, x in found or [(200, None)]}.items():
            responses.append((endpoint, status, 1, None, None))
            variants += [(endpoint, "response", status, *row) for row in trees.flat(shape)] if shape else []
        for slot, shape in others.items():
            variants += [(endpoint, slot, -1, *row) for row in trees.flat(shape)] if shape else []
    model = M.from_rows(spark, "claims", "source-code", ends, responses, variants)
    return Claims(model, spark.createDataFrame(refused, "endpoint string, slot string, ref string, reason string"))


def names(method: str, pattern: str) -> tuple[str, str]:
    """Operation id and type name of an endpoint."""
    words = [("By" if p.startswith(":") else "") + "".join(f[:1].upper() + f[1:] for f in re.split("[^a-zA-Z0-9]+", p) if f) for p in pattern.split("/") if p]
    name = method.lower() + "".join(words)
    return name, name[:1].upper() + name[1:]


def read_model(spark: SparkSession, path: str) -> tuple[M.Model, list[dict]]:
    """A model file's model, and its ``notAuditable`` entries; any JSON object with an ``endpoints`` array is one."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError(f'Failed to parse "{path}" as JSON: {error}') from None
    refused = found.get("notAuditable", []) if isinstance(found, dict) else []
    if isinstance(found, dict) and isinstance(found.get("model"), dict):
        found = found["model"]
    if not isinstance(found, dict) or not isinstance(found.get("endpoints"), list):
        raise ValueError(f'File "{path}" is no model: an object with an "endpoints" array is expected.')
    ends, responses, variants, params = [], [], [], []
    text = lambda e, k: json.dumps(e[k], ensure_ascii=False, separators=(",", ":")) if k in e else None
    for e in {f"{e['method'].upper()} {e['pattern']}": e for e in found["endpoints"]}.values():  # of equal ones the last counts
        endpoint = f"{e['method'].upper()} {e['pattern']}"
        own = names(e["method"], e["pattern"])
        ends.append((endpoint, e["method"], e["pattern"], sum(r.get("count", 0) for r in e.get("responses", [])), text(e, "requestSample"), e.get("operationId") or own[0], e.get("typeName") or own[1]))
        params += [(endpoint, p["index"], p["name"], p["format"], p.get("samples", [])) for p in e.get("params", [])]
        for r in e.get("responses", []):
            responses.append((endpoint, r["status"], r.get("count"), text(r, "sampleBody"), r.get("contentType")))
            variants += [(endpoint, "response", r["status"], *row) for row in trees.flat(r["bodyShape"])] if r.get("bodyShape") else []
        for slot, key in (("request", "requestBodyShape"), ("query", "queryShape")):
            variants += [(endpoint, slot, -1, *row) for row in trees.flat(e[key])] if e.get(key) else []
    return M.from_rows(spark, found.get("name", ""), found.get("target", ""), ends, responses, variants, params, found.get("generatedAt", 0)), refused


def write_claims(claims: Claims, path: str, strict: bool = False) -> bool:
    """Writes the claimed model and its refusals as JSON; with ``strict`` the answer is False where anything was refused."""
    from .emit import files

    model = json.loads(files(claims.model, ["model"]).first()["content"])
    refused = [{k: r[k] for k in ("endpoint", "slot", "ref", "reason")} for r in claims.not_auditable.orderBy("endpoint", "slot").collect()]
    Path(path).write_text(json.dumps({"model": model, "notAuditable": refused}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return not (strict and refused)
