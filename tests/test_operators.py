"""Rules of the scalar functions, shapes, emitters and streaming on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import formats
from tidemark.functions import scalars as S
from tidemark.operators import emit, endpoints, model, shapes
from tidemark.sources import exchanges as X
from tidemark.sources import store
from tidemark.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "pattern"),
    [
        ("/api/users/42", "/api/users/:userId"),
        ("/api/users/42/posts/99", "/api/users/:userId/posts/:postId"),
        ("/api/x/abc123", "/api/x/abc123"),
        ("/42", "/:param0"),
        ("/users/1/users/2/users/3", "/users/:userId/users/:userId1/users/:userId2"),
        ("/1/2/3", "/:param0/:param1/:param2"),
        ("/en/825/", "/en/:enId/"),
        ("users/7", "/users/:userId"),
        ("/notification-settings", "/:param0"),
        ("/categories/123e4567-e89b-12d3-a456-426614174000", "/categories/:categoryId"),
    ],
)
def test_normalize_path(spark, path, pattern):
    assert one(spark, S.normalize_path(F.col("p"))["pattern"], p=path) == pattern


def test_scalars(spark):
    assert one(spark, S.operation_name(F.lit("GET"), F.col("p")), p="/api/v1.2/foo-bar/:userId") == "getApiV12FooBarByUserId"
    assert [one(spark, S.coerce_query(F.col("v")), v=v) for v in ("42", "-7", "3.14", "1.0", "true", "admin", "1\n")] == ["integer", "integer", "number", "integer", "boolean", "string", "string"]
    assert [one(spark, S.singularize(F.col("v")), v=v) for v in ("users", "categories", "media", "ies", "s")] == ["user", "category", "media", "ie", "s"]
    assert one(spark, S.format_mask(F.col("v")), v="a@b.c\n") == 0 and one(spark, S.format_mask(F.col("v")), v="2024-01-05") == 4
    pairs = one(spark, S.parse_query(F.col("u")), u="/x?a=1&a=2&b=c%20d+e&f#top")
    assert [(p["key"], p["value"]) for p in pairs] == [("a", "1"), ("a", "2"), ("b", "c d e"), ("f#top", "")]


def test_headers_last_name_wins(spark):
    headers = F.create_map(F.lit("Cookie"), F.lit("a"), F.lit("X-A"), F.lit("1"), F.lit("x-a"), F.lit("2"))
    assert one(spark, S.normalize_headers(headers), u="") == {"cookie": "[redacted]", "x-a": "2"}


def random_json(r, depth=0):
    kind = r.choice(["null", "bool", "int", "num", "str", "obj", "arr"] if depth < 3 else ["null", "int", "str"])
    if kind == "obj":
        return {k: random_json(r, depth + 1) for k in r.sample("abcd", r.randint(0, 3))}
    if kind == "arr":
        return [random_json(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {"null": None, "bool": True, "int": r.randint(0, 9), "num": 1.5, "str": r.choice(["x", "2024-01-05", "a@b.c"])}[kind]


def fold(values, path="$", out=None):
    """Counts, kinds and formats of every path, by recursion over lists of values."""
    out = {} if out is None else out
    for v in values:
        family = "null" if v is None else "boolean" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"
        n, whole, mask = out.get((path, family), (0, True, 31))
        out[path, family] = (n + 1, whole and (family != "num" or float(v).is_integer()), mask & (formats.bits(v) if family == "string" else 31))
        if family == "object":
            for k, x in v.items():
                fold([x], f"{path}.{k}", out)
        if family == "array":
            fold(v, path + "[]", out)
    return out


def test_nodes_match_a_fold_in_any_order(spark):
    r = random.Random(5)
    values = [random_json(r) for _ in range(400)]
    rows = [("GET /x", 200, i, json.dumps(v)) for i, v in enumerate(values)] + [("GET /x", 200, 999, "{broken"), ("GET /x", 200, 1000, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "endpoint string, status int, ord long, body string").repartition(5)
    got = {(n["path"], n["family"]): (n["samples"], n["all_int"] in (None, True), 31 if n["fmt_mask"] is None else n["fmt_mask"]) for n in shapes.nodes(shapes.observe(df)).collect()}
    assert got == fold(values)


def test_key_order_and_duplicates():
    assert [(p, f) for p, _, _, f, *_ in shapes.walk('{"b":1,"2":0,"a":{},"1":null,"b":"x"}')] == [("$", "object"), ("$.1", "null"), ("$.2", "num"), ("$.b", "string"), ("$.a", "object")]


def test_render(spark):
    bodies = [{"id": 1, "role": "admin", "last": None}, {"id": 2, "role": "user", "last": "x", "tags": []}, {"id": 3, "role": "admin"}, {"id": 4, "role": "user"}]
    df = spark.createDataFrame([("GET /x", 200, i, json.dumps(b)) for i, b in enumerate(bodies)], "endpoint string, status int, ord long, body string")
    obs = model.observed(shapes.observe(df))
    ts = emit.render(obs, "types").first()["content"]
    assert ts == '{\n  id: number;\n  role: "admin" | "user";\n  last?: string | null;\n  tags?: unknown[];\n}'
    schema = json.loads(emit.render(obs, "json-schema").first()["content"])
    assert schema["required"] == ["id", "role"] and schema["properties"]["role"]["enum"] == ["admin", "user"]
    assert emit.render(obs, "spark-ddl").first()["content"] == "STRUCT<`id`: BIGINT, `role`: STRING, `last`: STRING, `tags`: ARRAY<STRING>>"


def test_recording_skips_corrupt_lines(spark, tmp_path):
    folder = tmp_path / "demo"
    folder.mkdir()
    line = {"id": "ex-1", "startedAt": 5, "request": {"method": "GET", "url": "/a?b", "path": "/a"}, "response": {"status": 200, "headers": {}, "bodyJson": None, "durationMs": 1}}
    (folder / "exchanges.ndjson").write_text(json.dumps(line) + "\n\n{broken\n" + json.dumps(line | {"id": "ex-2"}) + "\n")
    (folder / "meta.json").write_text(json.dumps({"name": "demo", "target": "t", "createdAt": 1, "updatedAt": 2, "exchangeCount": 2}))
    kept = store.Store(spark, str(tmp_path))
    found = kept.load("demo").orderBy("ord").collect()
    assert [f["id"] for f in found] == ["ex-1", "ex-2"] and found[0]["req_json"] is None and found[0]["res_json"] == "null"
    assert [r["name"] for r in kept.list().collect()] == ["demo"]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, "GET", f"/users/{i}", 200, "application/json", json.dumps({"a": i, "b": [1.5]} if i % 2 else {"a": None})) for i in range(20)]
    df = spark.createDataFrame(rows, ingest.LANDED)
    for k in range(2):
        df.where(F.col("ord") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.keep_nodes(ingest.landed(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    latest = F.max_by(F.struct("samples", "first_ord", "first_pos"), "samples")
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("endpoint", "path", "family").agg(latest.alias("x")).select("endpoint", "path", "family", "x.*")
    batch = shapes.nodes(shapes.observe(X.with_endpoint(df).select("endpoint", "status", "ord", "body")))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in batch.select("endpoint", "path", "family", "samples", "first_ord", "first_pos").collect()}


def test_param_samples_are_first_ten(spark):
    df = X.with_endpoint(spark.createDataFrame([(i, "GET", f"/users/{i % 15}") for i in range(40)], "ord long, method string, path string"))
    assert [r["value"] for r in endpoints.param_samples(df).orderBy("rank").collect()] == [str(i) for i in range(10)]
