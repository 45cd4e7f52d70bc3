"""Emitters: shapes as TypeScript types, zod, JSON Schema and Spark DDL, and the files of a whole API.

``rendered`` draws each shape once, a shape's places meeting in one task; files are then put together by joins and ordered
aggregates of texts, whose number is that of endpoints and statuses.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import scalars as S
from ..tables import kept
from . import endpoints, trees
from .model import Model
from .shapes import SHAPE

TARGETS = ("ts", "zod", "msw", "openapi", "model")
BANNER = "Generated by tidemark — do not edit."
RENDERED = "endpoint string, slot string, status int, ts string, zod string, schema string, ddl string, model string, interface boolean, query_params string"
METHODS = ("get", "post", "put", "patch", "delete", "options", "head")


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _plain(shape):
    """A tree without the counts that it doesn't have."""
    if isinstance(shape, dict):
        return {k: _plain(v) for k, v in shape.items() if not (v is None and k in ("seen", "samples"))}
    return [_plain(v) for v in shape] if isinstance(shape, list) else shape


def rendered(variants: DataFrame) -> DataFrame:
    """``RENDERED``: every shape as text of each kind."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = trees.build(trees.rows_of(pdf))[""]["shape"]
        fields = shape["fields"] if shape["kind"] == "object" else {}
        query = [{"name": k, "in": "query", "required": not f["optional"], "schema": trees.json_schema(f["shape"])} for k, f in fields.items()] if key[1] == "query" else []
        row = (*key, trees.ts(shape), trees.zod(shape), _dumps(trees.json_schema(shape)), trees.ddl(shape), _dumps(_plain(shape)), bool(fields), ",".join(map(_dumps, query)))
        return pd.DataFrame([row], columns=[c.split()[0] for c in RENDERED.split(", ")])

    return variants.groupBy(*SHAPE).applyInPandas(run, RENDERED)


def render(variants: DataFrame, target: str) -> DataFrame:
    """(endpoint, status, content): every response's shape as text."""
    column = {"types": "ts", "zod": "zod", "json-schema": "schema", "spark-ddl": "ddl", "model": "model"}[target]
    return rendered(variants.where("slot = 'response'")).select("endpoint", "status", F.col(column).alias("content"))


def _ends(model: Model) -> DataFrame:
    """Endpoints with their place in order and the status that stands for success."""
    place = F.row_number().over(Window.orderBy("pattern", "method"))  # a row for each endpoint
    return kept(model.endpoints.join(endpoints.success_status(model.responses).withColumnRenamed("status", "success"), "endpoint", "left").withColumn("place", place))


def _names(ends: DataFrame, shapes: DataFrame, model: Model) -> DataFrame:
    """Every shape that a file declares: its endpoint's names, its order, its suffix, and its texts (unknown where there is no body)."""
    bodies = model.responses.select("endpoint", F.lit("response").alias("slot"), "status").union(shapes.where("slot <> 'response'").select(*SHAPE))
    d = bodies.join(shapes, SHAPE, "left").join(ends, "endpoint")
    part = F.when(F.col("slot") == "query", F.lit("Query")).when(F.col("slot") == "request", F.lit("Request")).otherwise(F.lit("Response"))
    suffix = F.when(F.col("slot") == "response", S.response_suffix(F.col("status"), F.col("success"))).otherwise(F.lit(""))
    order = F.when(F.col("slot") == "query", 1).when(F.col("slot") == "request", 2).otherwise(3)
    return d.select("place", "endpoint", "operation_id", "type_name", "slot", "status", part.alias("part"), suffix.alias("suffix"), order.alias("order"), F.coalesce("ts", F.lit("unknown")).alias("ts"), F.coalesce("zod", F.lit("z.unknown()")).alias("zod"), F.coalesce("interface", F.lit(False)).alias("interface"))


def _joined(rows: DataFrame, order: Sequence[str], text: str, between: str) -> DataFrame:
    """One row: all texts in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("text"))))
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["text"]), between).alias("text"))


def _file(text: DataFrame, path: str, content: Column) -> DataFrame:
    return text.select(F.lit(path).alias("path"), content.alias("content"))


def types_file(model: Model, shapes: DataFrame, ends: DataFrame, banner: str = BANNER) -> DataFrame:
    """``types.ts``: parameters, query, request and responses of every endpoint, and the map of endpoints."""
    named = _names(ends, shapes, model)
    name = F.concat("type_name", "part", "suffix")
    declared = F.when(F.col("interface"), F.concat(F.lit("export interface "), name, F.lit(" "), "ts")).otherwise(F.concat(F.lit("export type "), name, F.lit(" = "), "ts", F.lit(";")))
    pieces = named.select("place", "order", "status", declared.alias("piece"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("index", "name"))), lambda p: F.concat(F.lit("  "), p["name"], F.lit(": string;")))
    params = model.params.groupBy("endpoint").agg(F.array_join(lines, "\n").alias("lines")).join(ends, "endpoint")
    own = params.select("place", F.lit(0).alias("order"), F.lit(-1).alias("status"), F.concat(F.lit("export interface "), "type_name", F.lit("Params {\n"), "lines", F.lit("\n}")).alias("piece"))
    slots = shapes.groupBy("endpoint").agg(F.bool_or(F.col("slot") == "query").alias("has_query"), F.bool_or(F.col("slot") == "request").alias("has_request"))
    refs = ends.join(slots, "endpoint", "left").join(params.select("endpoint", F.lit(True).alias("has_params")), "endpoint", "left")
    ref = lambda has, part: F.when(F.coalesce(F.col(has), F.lit(False)), F.concat("type_name", F.lit(part))).otherwise(F.lit("never"))
    response = F.when(F.col("success").isNotNull(), F.concat("type_name", F.lit("Response"))).otherwise(F.lit("never"))
    entry = F.concat(F.lit("  "), S._json_string(F.col("endpoint")), F.lit(": { params: "), ref("has_params", "Params"), F.lit("; query: "), ref("has_query", "Query"), F.lit("; request: "), ref("has_request", "Request"), F.lit("; response: "), response, F.lit(" };"))
    summary = _joined(refs.select("place", entry.alias("entry")), ["place"], "entry", "\n")
    last = summary.select(F.lit(2**31 - 1).alias("place"), F.lit(0).alias("order"), F.lit(0).alias("status"), F.concat(F.lit("export interface ApiEndpoints {\n"), "text", F.lit("\n}")).alias("piece"))
    text = _joined(pieces.union(own).union(last), ["place", "order", "status"], "piece", "\n\n")
    return _file(text, "types.ts", F.concat(F.lit(f"// {banner}\n\n"), "text", F.lit("\n")))


def zod_file(model: Model, shapes: DataFrame, ends: DataFrame, banner: str = BANNER) -> DataFrame:
    """``schemas.ts``: a schema and its inferred type for each query, request and response."""
    const, name = F.concat("operation_id", "part", F.lit("Schema"), "suffix"), F.concat("type_name", "part", "suffix")
    piece = F.concat(F.lit("export const "), const, F.lit(" = "), "zod", F.lit(";\nexport type "), name, F.lit(" = z.infer<typeof "), const, F.lit(">;"))
    text = _joined(_names(ends, shapes, model).withColumn("piece", piece), ["place", "order", "status"], "piece", "\n\n")
    return _file(text, "schemas.ts", F.concat(F.lit(f"// {banner}\nimport {{ z }} from 'zod';\n\n"), "text", F.lit("\n")))


def _whole(number: str) -> int | float:
    x = float(number)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def pretty(text: Column | str) -> Column:
    """JSON text with an indent of two, keys as they stand."""

    def draw(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t, parse_float=_whole), indent=2, ensure_ascii=False))

    return pandas_udf(draw, "string")(text)


def _samples(model: Model, ends: DataFrame) -> DataFrame:
    return model.responses.join(ends, "endpoint").withColumn("sample", pretty("sample_body"))


def mock_file(model: Model, ends: DataFrame, banner: str = BANNER, base: str = "*", fixtures: bool = False) -> DataFrame:
    """``handlers.ts``: a handler for each endpoint's success, the other statuses as comments."""
    method = F.when(F.lower("method").isin(*METHODS), F.lower("method")).otherwise(F.lit("all"))
    head = F.concat(F.lit("  http."), method, F.lit(f"('{base}"), "pattern", F.lit("', () =>"))
    body = F.concat("operation_id", F.lit("Response"), "status") if fixtures else F.replace("sample", F.lit("\n"), F.lit("\n      "))
    full = F.concat(head, F.lit("\n    HttpResponse.json("), body, F.lit(", { status: "), "status", F.lit(" }),\n  )"))
    none = F.concat(head, F.lit(" new HttpResponse(null, { status: "), "status", F.lit(" }))"))
    handler = F.when(F.col("sample").isNull(), none).otherwise(full)
    rest = F.array_join(F.transform(F.split(handler, "\n"), lambda line: F.concat(F.lit("  // "), F.substring(line, F.lit(3), F.length(line)))), "\n")
    first = F.col("status") == F.col("success")
    rows = _samples(model, ends).select("place", "endpoint", (~first).alias("other"), "status", F.concat(F.when(first, handler).otherwise(rest), F.lit(",")).alias("line"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("other", "status", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy("place", "endpoint").agg(listed.alias("lines")).withColumn("block", F.concat(F.lit("  // "), "endpoint", F.lit("\n"), "lines"))
    text = _joined(blocks, ["place"], "block", "\n\n").withColumn("one", F.lit(1))
    found = _samples(model, ends).where("sample is not null").withColumn("line", F.concat(F.lit("import "), "operation_id", F.lit("Response"), "status", F.lit(" from './fixtures/"), "operation_id", F.lit("."), "status", F.lit(".json';\n")))
    imports = _joined(found if fixtures else found.where("false"), ["place", "status"], "line", "").select(F.col("text").alias("imports"), F.lit(1).alias("one"))
    start = F.concat(F.lit(f"// {banner}\nimport {{ http, HttpResponse }} from 'msw';\n"), "imports", F.lit("\nexport const handlers = ["))
    return _file(text.join(imports, "one"), "handlers.ts", F.concat(start, F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("\n"), "text", F.lit("\n"))), F.lit("];\n")))


def fixture_files(model: Model, ends: DataFrame) -> DataFrame:
    """A file for each response that has a sample."""
    found = _samples(model, ends).where("sample is not null")
    return found.select(F.concat(F.lit("fixtures/"), "operation_id", F.lit("."), F.col("status").cast("string"), F.lit(".json")).alias("path"), F.concat("sample", F.lit("\n")).alias("content"))


def openapi_file(model: Model, shapes: DataFrame, ends: DataFrame, banner: str = BANNER) -> DataFrame:
    """``openapi.json``: the whole document."""
    q = S._json_string
    content = lambda c: F.concat(F.lit('"content":{"application/json":{"schema":'), c, F.lit("}}"))
    bodies = model.responses.join(shapes.where("slot = 'response'"), ["endpoint", "status"], "left")
    one = F.concat(F.lit('"'), "status", F.lit('":{"description":"Status '), "status", F.lit('"'), F.when(F.col("schema").isNotNull(), F.concat(F.lit(","), content(F.col("schema")))).otherwise(""), F.lit("}"))
    listed = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("text")))), lambda x: x["text"]), ",")
    responses = bodies.groupBy("endpoint").agg(listed("status", one).alias("responses"))
    kind = F.when(F.col("format") == "uuid", '{"type":"string","format":"uuid"}').when(F.col("format") == "integer", '{"type":"integer"}').otherwise('{"type":"string"}')
    param = F.concat(F.lit('{"name":'), q(F.col("name")), F.lit(',"in":"path","required":true,"schema":'), kind, F.lit("}"))
    params = model.params.groupBy("endpoint").agg(listed("index", param).alias("params"))
    query = shapes.where("slot = 'query'").select("endpoint", "query_params")
    request = shapes.where("slot = 'request'").select("endpoint", content(F.col("schema")).alias("request"))
    d = ends.join(responses, "endpoint", "left").join(params, "endpoint", "left").join(query, "endpoint", "left").join(request, "endpoint", "left")
    all_params = F.concat_ws(",", F.nullif("params", F.lit("")), F.nullif("query_params", F.lit("")))
    operation = F.concat(
        q(F.lower("method")), F.lit(':{"operationId":'), q(F.col("operation_id")), F.lit(',"responses":{'), F.coalesce("responses", F.lit("")), F.lit("}"),
        F.when(all_params != "", F.concat(F.lit(',"parameters":['), all_params, F.lit("]"))).otherwise(""), F.when(F.col("request").isNotNull(), F.concat(F.lit(',"requestBody":{'), "request", F.lit("}"))).otherwise(""), F.lit("}"),
    )
    paths = d.groupBy(S.openapi_path(F.col("pattern")).alias("path")).agg(F.min("place").alias("place"), listed("place", operation).alias("operations"))
    text = _joined(paths.withColumn("item", F.concat(q(F.col("path")), F.lit(":{"), "operations", F.lit("}"))), ["place"], "item", ",")
    top = F.concat(F.lit(f'{{"x-generated-by":{_dumps(banner)},"openapi":"3.1.0","info":{{"title":{_dumps(model.name + " (recorded)")},"version":"0.0.0"}},"servers":[{{"url":{_dumps(model.target)}}}],"paths":{{'), "text", F.lit("}}"))
    return _file(text, "openapi.json", F.concat(pretty(top), F.lit("\n")))


def model_file(model: Model, shapes: DataFrame, ends: DataFrame) -> DataFrame:
    """``model.json``: the model as interchange, which ``claims.read_model`` reads.  Exchange ids are no part of it; they grow with
    the recording and are a table of their own."""
    q = S._json_string
    both = model.responses.join(shapes.where("slot = 'response'").select("endpoint", "status", "model"), ["endpoint", "status"], "left")
    one = F.concat(
        F.lit('{"status":'), "status", F.lit(',"bodyShape":'), F.coalesce("model", F.lit("null")), F.lit(',"count":'), "count", F.coalesce(F.concat(F.lit(',"sampleBody":'), "sample_body"), F.lit("")),
        F.coalesce(F.concat(F.lit(',"contentType":'), q(F.col("content_type"))), F.lit("")), F.lit("}"),
    )
    listed = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("text")))), lambda x: x["text"]), ",")
    responses = both.groupBy("endpoint").agg(listed("status", one).alias("responses"))
    params = model.params.groupBy("endpoint").agg(listed("index", F.to_json(F.struct("name", "index", "format", "samples"))).alias("params"))
    of = lambda slot: shapes.where(F.col("slot") == slot).select("endpoint", F.col("model").alias(slot))
    d = ends.join(responses, "endpoint", "left").join(params, "endpoint", "left").join(of("query"), "endpoint", "left").join(of("request"), "endpoint", "left")
    end = F.concat(
        F.lit('{"method":'), q(F.col("method")), F.lit(',"pattern":'), q(F.col("pattern")), F.lit(',"params":['), F.coalesce("params", F.lit("")), F.lit('],"queryShape":'), F.coalesce("query", F.lit("null")), F.lit(',"requestBodyShape":'), F.coalesce("request", F.lit("null")),
        F.lit(',"responses":['), F.coalesce("responses", F.lit("")), F.lit('],"exchangeIds":[],"operationId":'), q(F.col("operation_id")), F.lit(',"typeName":'), q(F.col("type_name")), F.coalesce(F.concat(F.lit(',"requestSample":'), "request_sample"), F.lit("")), F.lit("}"),
    )
    text = _joined(d.withColumn("end", end), ["place"], "end", ",")
    top = F.concat(F.lit(f'{{"name":{_dumps(model.name)},"target":{_dumps(model.target)},"generatedAt":{model.generated_at},"endpoints":['), "text", F.lit("]}"))
    return _file(text, "model.json", F.concat(pretty(top), F.lit("\n")))


def parse_targets(text: str) -> list[str]:
    """Targets of a list with commas, each once; ValueError for one that isn't known, or none."""
    found = list(dict.fromkeys(t.strip() for t in text.split(",") if t.strip()))
    wrong = [t for t in found if t not in TARGETS]
    if wrong or not found:
        raise ValueError(f"{f'Unknown target {chr(34)}{wrong[0]}{chr(34)}' if wrong else 'No targets'}. Valid targets: {', '.join(TARGETS)}")
    return found


def files(model: Model, targets: Sequence[str] = TARGETS, banner: str = BANNER, base: str = "*", fixtures: bool = False) -> DataFrame:
    """(path, content) of the files of ``targets``, in that order."""
    shapes, ends = kept(rendered(model.variants)), _ends(model)
    out = []
    for target in parse_targets(",".join(targets)):
        if target == "ts":
            out.append(types_file(model, shapes, ends, banner))
        elif target == "zod":
            out.append(zod_file(model, shapes, ends, banner))
        elif target == "msw":
            out.append(mock_file(model, ends, banner, base, fixtures))
            if fixtures:
                out.append(fixture_files(model, ends))
        elif target == "openapi":
            out.append(openapi_file(model, shapes, ends, banner))
        else:
            out.append(model_file(model, shapes, ends))
    return reduce(DataFrame.union, out)


def write_files(found: DataFrame, folder: str) -> list[str]:
    """Writes ``files`` under a folder, by the tasks that have them; returns the paths."""
    from ..sources import files as sink

    return sink.write(kept(found), folder)


def openapi(exchanges: DataFrame, variants: DataFrame) -> DataFrame:
    """A path item's operation for each endpoint, as JSON text."""
    schemas = render(variants, "json-schema").groupBy("endpoint").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("status").cast("string"), "content")))).alias("by_status"))
    ends = exchanges.select("endpoint", "method", "pattern").distinct()
    return ends.join(schemas, "endpoint").select(S.openapi_path(F.col("pattern")).alias("path"), F.lower("method").alias("method"), S.operation_name(F.col("method"), F.col("pattern")).alias("operation_id"), F.to_json("by_status").alias("responses"))


def mock_handlers(exchanges: DataFrame, samples: DataFrame) -> DataFrame:
    """A request handler for each endpoint and status that answers with its latest sample."""
    d = exchanges.select("endpoint", "method", "pattern").distinct().join(samples, "endpoint")
    text = F.format_string("http.%s('*%s', () => HttpResponse.json(%s, { status: %d }))", F.lower("method"), "pattern", F.coalesce("sample", F.lit("null")), "status")
    return d.select("endpoint", "status", text.alias("content"))
