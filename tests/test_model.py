"""Models, drift, claims, files, reports and the store on small fixtures whose results are stated."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemark import config
from tidemark.functions import scalars as S
from tidemark.operators import claims, diff, emit, model, reports, shapes, trees
from tidemark.sources import demo, store
from tidemark.sources import exchanges as X

COLUMNS = "ord long, method string, path string, status int, body string, req_body string, url string, content_type string"
DICT = {f"k{j}": j for j in range(14)}


def built(spark, rows, name="m"):
    return model.build(X.with_endpoint(spark.createDataFrame(rows, COLUMNS)), name)


def get(i, body, url=None, status=200, method="GET", path="/x", sent=None):
    text = lambda b: None if b is None else json.dumps(b)
    return i, method, path, status, text(body), text(sent), url or path, "application/json"


def found(a, b, **options):
    return [tuple(r) for r in diff.in_order(diff.findings(a, b, **options)).select("severity", "kind", "path", "before", "after", "b_samples").collect()]


@pytest.fixture(scope="module")
def sides(spark):
    a = [get(i, {"id": i, "role": ["admin", "user"][i % 2], "v": 1, "gone": "x y", "d": DICT, "tags": ["a b"], "nul": "x y", "opt": 1}, url="/x?page=1") for i in range(8)]
    b = []
    for i in range(8):
        body = {"id": str(i), "role": ["admin", "owner"][i % 2], "v": 1.5 if i % 2 else True, "d": {k: "s t" for k in DICT}, "tags": [], "nul": None if i % 2 else "x y", "new": True}
        b.append(get(i, body | ({"opt": 2} if i else {}), url="/x"))
    a.append(get(20, {"id": 1}, status=201, method="POST", path="/y", sent={"name": "n m"}))
    b.append(get(20, None, status=201, method="POST", path="/y"))
    return built(spark, a, "a"), built(spark, b, "b")


def test_findings(sides):
    want = {
        ("breaking", "type-changed", "d{}", "number (integer)", "string", 8), ("breaking", "field-removed", "gone", "string", None, 8), ("breaking", "type-changed", "id", "number (integer)", "string", 8),
        ("breaking", "nullability-changed", "nul", "string", "string | null", 8), ("breaking", "type-changed", "tags[]", "string", "none", 8), ("breaking", "type-changed", None, "{\n  id: number;\n}", "none", 1),
        ("risky", "optionality-changed", "opt", "number (integer)", "number (integer)", 8), ("risky", "enum-values-changed", "role", '"admin" | "user"', '"admin" | "owner"', 8),
        ("risky", "type-changed", "v", "number (integer)", "boolean", 8), ("risky", "type-changed", "v", "number (integer)", "number", 8), ("info", "type-changed", "v", "number (integer)", "boolean | number", 8),
        ("info", "field-added", "new", None, "boolean", 8), ("info", "query-changed", "query", "{\n  page: number;\n}", "none", None), ("info", "enum-values-changed", "role", '"admin" | "user"', '"admin" | "owner"', 8),
        ("info", "request-changed", "request", "{\n  name: string;\n}", "none", None),
    }
    got = found(*sides)
    assert set(got) == want and len(got) == len(want)
    assert [diff.RANK[g[0]] for g in got] == sorted(diff.RANK[g[0]] for g in got)
    assert found(sides[0], sides[0]) == []
    assert {g[1] for g in found(*reversed(sides)) if g[0] == "breaking"} >= {"request-changed", "field-removed", "type-changed"}


def test_endpoints_of_one_side(spark, sides):
    lone = built(spark, [get(1, [], path="/z")], "lone")
    counts = diff.summary(sides[0], lone, diff.findings(sides[0], lone, ignore_unmatched=True)).first()
    assert (counts["endpoints_compared"], counts["endpoints_only_in_a"], counts["endpoints_only_in_b"], counts["breaking"]) == (0, 2, 1, 0)
    assert {f[1] for f in found(sides[0], lone)} == {"endpoint-removed", "endpoint-added"}
    every = diff.findings(sides[0], lone)
    assert diff.at_least(every, "breaking") and not diff.at_least(every.where("severity = 'info'"), "risky")


def test_nested_dictionaries_and_vocabularies(spark):
    entry = lambda k: {"state": ["on", "off"][k % 2], "inner": {f"i{j}": [j] for j in range(12)}}
    rows = [get(i, {"all": {f"u{k}": entry(k) for k in range(i, i + 13)}, "maybe": None if i % 2 else {"word": "same"}}) for i in range(6)]
    got = {(r["path"].replace("\x1f", ""), r["kind"]): r for r in built(spark, rows).variants.collect()}
    assert {k for k in got if k[0].startswith(".all")} == {(".all", "record"), (".all{}", "object"), (".all{}.inner", "record"), (".all{}.inner{}", "array"), (".all{}.inner{}[]", "primitive"), (".all{}.state", "primitive")}
    assert sorted(got[".all{}.state", "primitive"]["enum"]) == ["off", "on"]
    assert got[".maybe.word", "primitive"]["enum"] is None  # below a union
    assert got[".maybe", "object"]["variant"] == 0 and got[".maybe", "null"]["variant"] == 1


@pytest.mark.parametrize(("values", "closed"), [(["a", "b", "a", "b"], True), (["a", "b", "a"], False), (["a b", "c", "a b", "c"], False), (["30", "20", "30", "20"], False), (["050015", "050020", "050015", "050020"], True), (list("abcdefghi") * 3, False), (["a", "b", "c", "d"], False)])
def test_vocabularies(spark, values, closed):
    rows = built(spark, [get(i, {"s": v}) for i, v in enumerate(values)]).variants.where("key = 's'").collect()
    assert rows[0]["enum"] == (list(dict.fromkeys(values)) if closed else None)


def test_keys_with_marks_and_prototype_names(spark):
    rows = built(spark, [get(1, {"a.b": {"[]": 1}, "constructor": "x", "é\x1f": None, "2": 1, "1": 2})]).variants.orderBy("place").where("parent = ''").collect()
    assert [r["key"] for r in rows] == ["1", "2", "a.b", "constructor", "é\\u001f"]


def test_files(sides):
    files = {r["path"]: r["content"] for r in emit.files(sides[0], fixtures=True).collect()}
    assert list(files) == ["types.ts", "schemas.ts", "handlers.ts", "fixtures/getX.200.json", "fixtures/postY.201.json", "openapi.json", "model.json"]
    assert "export interface GetXQuery {\n  page: number;\n}" in files["types.ts"] and "d: Record<string, number>;" in files["types.ts"]
    assert '  "POST /y": { params: never; query: never; request: PostYRequest; response: PostYResponse };' in files["types.ts"]
    assert "export const getXResponseSchema = z.object({\n  id: z.number().int(),\n  role: z.enum([\"admin\", \"user\"])," in files["schemas.ts"]
    assert "import postYResponse201 from './fixtures/postY.201.json';" in files["handlers.ts"] and "  // POST /y\n  http.post('*/y', () =>\n    HttpResponse.json(postYResponse201, { status: 201 }),\n  )," in files["handlers.ts"]
    document = json.loads(files["openapi.json"])
    assert document["paths"]["/x"]["get"]["parameters"] == [{"name": "page", "in": "query", "required": True, "schema": {"type": "integer"}}]
    assert document["paths"]["/y"]["post"]["requestBody"]["content"]["application/json"]["schema"]["required"] == ["name"]
    assert {e["operationId"] for e in json.loads(files["model.json"])["endpoints"]} == {"getX", "postY"}
    with pytest.raises(ValueError):
        emit.parse_targets("ts,nope")
    assert emit.parse_targets(" zod, ts,zod ") == ["zod", "ts"]


def test_other_statuses_are_comments(spark):
    m = built(spark, [get(1, {"a": 1}), get(2, {"e": [1.0, 2.5]}, status=404), get(3, None, status=500)])
    text = emit.files(m, ["msw"]).first()["content"]
    assert "  http.get('*/x', () =>\n    HttpResponse.json({\n        \"a\": 1\n      }, { status: 200 }),\n  )," in text
    assert "  // http.get('*/x', () =>\n  //   HttpResponse.json({" in text and "  // http.get('*/x', () => new HttpResponse(null, { status: 500 }))," in text and "1.0" not in text


def test_model_file_round_trip(spark, sides, tmp_path):
    emit.write_files(emit.files(sides[1], ["model"]), str(tmp_path))
    again, refused = claims.read_model(spark, str(tmp_path / "model.json"))
    assert found(sides[1], again) == [] and refused == [] and found(sides[0], again) == found(*sides)
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        claims.read_model(spark, str(tmp_path / "bad.json"))


SHAPES = [
    ({"kind": "primitive", "type": "string", "formats": ["date-time"]}, "string", "z.string().datetime()", {"type": "string", "format": "date-time"}),
    ({"kind": "primitive", "type": "string", "formats": ["date"]}, "string", r"z.string().regex(/^\d{4}-\d{2}-\d{2}$/)", {"type": "string", "format": "date"}),
    ({"kind": "record", "value": {"kind": "primitive", "type": "integer"}}, "Record<string, number>", "z.record(z.number().int())", {"type": "object", "additionalProperties": {"type": "integer"}}),
    ({"kind": "union", "variants": [{"kind": "primitive", "type": "string"}, {"kind": "primitive", "type": "integer"}, {"kind": "null"}]}, "string | number | null", "z.union([z.string(), z.number().int(), z.null()])", {"anyOf": [{"type": "string"}, {"type": "integer"}, {"type": "null"}]}),
    ({"kind": "union", "variants": [{"kind": "primitive", "type": "string"}, {"kind": "null"}]}, "string | null", "z.string().nullable()", {"type": ["string", "null"]}),
    ({"kind": "primitive", "type": "integer", "enum": [1, 2]}, "1 | 2", "z.union([z.literal(1), z.literal(2)])", {"type": "integer", "enum": [1, 2]}),
    ({"kind": "array", "element": {"kind": "primitive", "type": "string", "enum": ["a", "b"]}}, 'Array<"a" | "b">', 'z.array(z.enum(["a", "b"]))', {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}),
    ({"kind": "array", "element": None}, "unknown[]", "z.array(z.unknown())", {"type": "array", "items": {}}),
    ({"kind": "object", "fields": {}}, "Record<string, never>", "z.object({})", {"type": "object", "properties": {}}),
    ({"kind": "unknown"}, "unknown", "z.unknown()", {}),
]


@pytest.mark.parametrize(("shape", "ts", "zod", "schema"), SHAPES)
def test_texts(shape, ts, zod, schema):
    assert (trees.ts(shape), trees.zod(shape), trees.json_schema(shape)) == (ts, zod, schema)
    names = ["path", "parent", "key", "kind", "type", "formats", "enum", "samples", "seen", "optional", "place", "variant", "copy"]
    again = trees.build([dict(zip(names, row, strict=True)) for row in trees.flat(shape)])[""]["shape"]
    assert trees.equal(again, shape)


def test_claims(spark, tmp_path):
    document = {"$defs": {"User": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "role": {"enum": ["b", "a"]}}}, "Loop": {"type": "object", "properties": {"next": {"$ref": "#/$defs/Loop"}}}}}
    (tmp_path / "types.json").write_text(json.dumps(document))
    entries = [
        {"method": "get", "pattern": "/x", "response": "types.json#User"}, {"method": "get", "pattern": "/x", "status": 404, "response": "types.json#Missing"},
        {"method": "GET", "pattern": "/loop", "response": "types.json#Loop"}, {"method": "GET", "pattern": "/query", "query": {"type": "object", "properties": {"q": {"type": "string"}}}, "response": "nowhere"},
    ]
    (tmp_path / "map.json").write_text(json.dumps({"entries": entries}))
    got = claims.extract(spark, claims.load_map(str(tmp_path / "map.json")), str(tmp_path))
    assert {(r["endpoint"], r["slot"]) for r in got.not_auditable.collect()} == {("GET /x", "response[404]"), ("GET /loop", "response[200]"), ("GET /query", "response[200]")}
    assert {(r["endpoint"], r["status"]) for r in got.model.responses.collect()} == {("GET /x", 200), ("GET /query", 200)}
    observed = built(spark, [get(i, {"id": str(i), "role": "c"}) for i in range(4)])
    assert {f[:3] for f in found(got.model, observed, ignore_unmatched=True)} == {("breaking", "type-changed", "id"), ("risky", "enum-values-changed", "role"), ("info", "enum-values-changed", "role"), ("info", "optionality-changed", "role")}
    assert not claims.write_claims(got, str(tmp_path / "claims.json"), strict=True)
    assert len(claims.read_model(spark, str(tmp_path / "claims.json"))[1]) == 3


def test_unknown_sides(spark):
    claim = lambda schema: claims.extract(spark, [{"method": "GET", "pattern": "/x", "response": schema}]).model
    known, unknown = claim({"type": "object", "properties": {"a": {"type": "string"}}}), claim({"type": "object", "properties": {"a": {}}})
    assert [f[:2] for f in found(unknown, known)] == [("info", "type-changed")] and [f[:2] for f in found(known, unknown)] == [("risky", "type-changed")]
    two = claim({"anyOf": [{"type": "object", "properties": {"a": {"type": "string"}}}, {"type": "object", "properties": {"b": {"type": "string"}}}]})
    assert found(two, two) == [] and [f[:3] for f in found(two, known)] == [("info", "optionality-changed", "a")][:0] + [("info", "type-changed", None)]


@pytest.mark.parametrize("type_", [T.BinaryType(), T.DateType(), T.MapType(T.IntegerType(), T.StringType()), T.StructType([T.StructField("a", T.StringType())])])
def test_spark_types_without_a_shape(type_):
    with pytest.raises(claims.Refusal):
        claims.from_spark_type(type_)


def test_spark_types():
    type_ = T.StructType([T.StructField("b", T.ArrayType(T.LongType(), False), False), T.StructField("a", T.StringType(), True, {"nullable": True, "enum": ["y", "x"]}), T.StructField("c", T.VariantType(), True, {"optional": True})])
    assert trees.ts(claims.from_spark_type(type_)) == '{\n  a: "x" | "y" | null;\n  b: number[];\n  c?: unknown;\n}'


def test_literals_and_unions():
    assert claims.from_json_schema({"anyOf": [{"const": "a"}, {"type": "string"}, {"type": "null"}]}) == {"kind": "union", "variants": [{"kind": "primitive", "type": "string"}, {"kind": "null"}]}
    assert claims.literals([3, 1, 2.5, True]) == {"kind": "union", "variants": [{"kind": "primitive", "type": "number", "enum": [1, 2.5, 3]}, {"kind": "primitive", "type": "boolean"}]}
    for bad in (False, {"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "string"}}, {"enum": [[1]]}):
        with pytest.raises(claims.Refusal):
            claims.from_json_schema(bad)
    deep = {"type": "string"}
    for _ in range(40):
        deep = {"type": "array", "items": deep}
    with pytest.raises(claims.Refusal):
        claims.from_json_schema(deep)
    assert claims.parse_ref("a#b#C") == ("a#b", "C")


def test_reports(sides):
    every = diff.findings(*sides)
    text = reports.markdown(*sides, every, "xx").first()["content"]
    assert text.startswith("# drift report\n\nCompared `a` (a) → `b` (b): 6 breaking, 4 risky, 5 info · 2 endpoints compared, 0 only in a, 0 only in b.\n\n## Breaking (6)\n\n| Kind | Endpoint |")
    assert '| enum values changed | GET /x | [200] role | "admin" \\| "user" → "admin" \\| "owner" | 8 |' in text and "| 1 ⚠ |" in text and text.endswith("these findings.\n")
    assert "## 호환성 깨짐 (6)" in reports.markdown(*sides, every, "ko").first()["content"]
    assert reports.markdown(sides[0], sides[0], diff.findings(sides[0], sides[0])).first()["content"].endswith("\n\nNo drift detected.\n")
    plain = reports.plain(*sides, every).first()["content"]
    assert "BREAKING (6)\nSEVERITY | KIND" in plain and max(len(line.split(" | ")[4].rstrip()) for line in plain.splitlines() if line.startswith(("breaking", "risky", "info"))) <= 60
    assert reports.gen_table(sides[0]).first()["content"].splitlines()[2] == "GET    | /x      | 200      | 8"


def test_demo_drift(spark):
    a, b = (model.build(demo.exchanges(spark, v), f"v{v}") for v in (1, 2))
    assert (demo.exchanges(spark, 1).count(), demo.exchanges(spark, 2).count()) == (19, 11)
    got = {f[1:3] for f in found(a, b, ignore_unmatched=True) if f[0] == "breaking"}
    assert got == {("field-removed", "data[].avatarUrl"), ("type-changed", "data[].lastLoginAt"), ("field-removed", "avatarUrl"), ("type-changed", "lastLoginAt")}


def test_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    first = kept.init("r", "http://a")
    header = {"Content-Type": "application/json", "Cookie": "c", "X-A": "1"}
    raw = spark.createDataFrame([(i, "get", f"/u/{i}?q=a&q=b", header, bytearray(b'{"a": 1}'), 200, header, bytearray(b"null" if i else b"\xff{"), 10, 15) for i in range(4)], "ord long, method string, url string, req_headers map<string,string>, req_body binary, status int, res_headers map<string,string>, res_body binary, started_at long, ended_at long")
    captured = store.capture(raw)
    assert kept.append("r", captured, "one")["exchangeCount"] == 4 and kept.append("r", captured, "one")["exchangeCount"] == 4 and kept.append("r", captured, "two")["exchangeCount"] == 8
    rows = kept.load("r").orderBy("ord").collect()
    assert [r["url"] for r in rows] == [f"/u/{i}?q=a&q=b" for i in range(4)] * 2 and [r["res_json"] for r in rows[:2]] == [None, "null"]
    assert rows[0]["req_headers"] == {"content-type": "application/json", "cookie": "[redacted]", "x-a": "1"} and rows[0]["query"] == {"q": ["a", "b"]} and rows[0]["duration_ms"] == 5 and rows[0]["method"] == "GET"
    again = kept.init("r", "http://b")
    assert (again["createdAt"], again["exchangeCount"], again["target"]) == (first["createdAt"], 8, "http://b")
    assert kept.model("r").variants.where("slot = 'query' and kind = 'array'").count() == 1
    assert store.resolve_recording(kept) == "r" and store.resolve_side(spark, kept, "r")[1] == []
    kept.init("q", "")
    with pytest.raises(ValueError):
        store.resolve_recording(kept)
    with pytest.raises(FileNotFoundError):
        kept.load("missing")
    with pytest.raises(ValueError):
        store.resolve_side(spark, kept, "missing")
    kept.remove("r")
    assert [r["name"] for r in kept.list().collect()] == ["q"] and (tmp_path / "s" / ".gitignore").read_text().endswith("*\n")
    assert store.diff_sides("a", "b") == store.diff_sides(claims="a", observed="b") == ("a", "b")
    for wrong in ({"a": "x"}, {"a": "x", "b": "y", "claims": "z"}, {"claims": "z"}):
        with pytest.raises(ValueError):
            store.diff_sides(**wrong)


def test_decode_content(spark):
    import gzip
    import zlib

    plain = b"body" * 9
    raw = zlib.compressobj(wbits=-15)
    rows = [(bytearray(gzip.compress(plain)), "GZIP"), (bytearray(zlib.compress(plain)), "deflate"), (bytearray(raw.compress(plain) + raw.flush()), " deflate"), (bytearray(plain), None), (bytearray(plain), "gzip")]
    df = spark.createDataFrame(rows, "b binary, e string")
    assert [bytes(r["x"]) for r in df.select(store.decode_content(F.col("b"), F.col("e")).alias("x")).collect()] == [plain] * 5


def test_config(tmp_path):
    assert config.load(str(tmp_path)) is None
    (tmp_path / config.FILE).write_text('{"dir": "d", "targets": ["ts"], "other": 1}')
    assert config.load(str(tmp_path)) == config.Config(dir="d", targets=["ts"])
    for bad in ("[]", "{"):
        (tmp_path / config.FILE).write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path))
    assert config.layer({"dir": "x", "name": "n"}, {"dir"}, {"dir": "y", "name": "m", "out": None}) == {"dir": "x", "name": "m"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    cut = one(S.decode_body(F.lit("é" * 100), 127))
    assert cut["text"] == "é" * 63 + "�" and cut["json"] is None
    typed = [one(S.decode_body(F.lit('{"a":1}'), 99, F.lit(t)))["json"] for t in ("application/JSON", "text/plain", None)]
    assert typed == ['{"a":1}', None, None] and one(S.decode_body(F.lit(""), 9))["text"] is None
    numbers = {"30": True, "-2": True, "0.5": True, "050015": False, "1.50": False, "9007199254740993": False, "9007199254740992": True, "1e-7": True, "0.0000001": False, "0.000001": True, "Infinity": False, "-0": False, "123456789012345678": False, "abc": False}
    df = spark.createDataFrame([(k,) for k in numbers], "v string")
    assert {r["v"]: r["x"] for r in df.select("v", S.is_numeric_data(F.col("v")).alias("x")).collect()} == numbers == {k: shapes.is_numeric_text(k) for k in numbers}
    assert one(S.strip_hop_by_hop(F.create_map(F.lit("Connection"), F.lit("1"), F.lit("Proxy-X"), F.lit("2"), F.lit("X-A"), F.lit("3")))) == {"X-A": "3"}
    assert one(S.query_json(F.lit("/x?b=1&b=x&a=007&c=true&d=1.0"))) == '{"b":[1,"x"],"a":7,"c":true,"d":1.0}'
    assert one(S.timestamp_text(F.lit(1704067200123))) == "2024-01-01T00:00:00.123Z" and one(S.timestamp_text(F.lit(0))) == "-"


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("select format_mask('2024-01-05T10:00:00Z') a, format_mask('a@b.c') b, singularize('categories') c, classify_segment('42') d, operation_name('GET', '/api/v1.2/foo-bar/:userId') e, coerce_query('1.0') f, path_only('/a?b#c') g, openapi_path('/a/:b') h, sanitize_name('--') i, endpoint_key('get', '/x') j").first()
    assert tuple(row) == (2, 8, "category", "integer", "getApiV12FooBarByUserId", "integer", "/a", "/a/{b}", "param", "GET /x")
    assert [r["path"] for r in spark.sql("select path from json_nodes('{\"a\":[1]}') order by pos").collect()] == ["$", "$.a", "$.a[]"]
