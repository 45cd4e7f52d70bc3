"""Identity of shapes, deep bodies, inflated bodies, files written by tasks, and the table function of JSON nodes."""

import gzip
import json
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.functions import scalars as S
from tidemark.operators import model, shapes, trees
from tidemark.sources import files, store

BODIES = "endpoint string, status int, ord long, body string"


def test_records_are_of_one_shape_only(spark):
    """Keys whose former signatures, remainders of 31 bits, were the same: objects of these keys are different shapes."""
    sig = F.xxhash64(F.xxhash64(F.lit("num"), F.lit(True), F.lit(0)) % 2**31, F.lit(1).cast("long"))
    keys = spark.range(400_000).select(F.format_string("f%d", "id").alias("k"))
    twins = keys.groupBy((F.xxhash64("k", F.lit(False), sig) % 2**31).alias("h")).agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").first()
    one = {f"k{i}": {twins["a"]: 1} for i in range(14)}
    two = {f"k{i}": {twins["a"] if i % 2 else twins["b"]: 1} for i in range(14)}
    df = spark.createDataFrame([("GET /one", 200, 1, json.dumps(one)), ("GET /two", 200, 2, json.dumps(two))], BODIES)
    assert [(r["endpoint"], r["keys"]) for r in shapes.records(shapes.observe(df)).collect()] == [("GET /one", 14)]


def test_records_whose_shapes_differ_in_parts(spark):
    """Lists of parts that read alike when joined are told apart: an object {a: {b: int}} is no {a: {}, b: int}, nor [[int]] an [int]."""
    pairs = [({"a": {"b": 1}}, {"a": {}, "b": 1}), ([[1]], [1]), ({"ab": 1}, {"a": 1, "b": 1}), ({"a": None}, {"a": "x y"}), ([], [None]), ({"1:a": 1}, {"1": {"a": 1}})]
    rows = [(f"GET /{k}", 200, k, json.dumps({f"k{i}": pair[i % 2] for i in range(12)})) for k, pair in enumerate(pairs)] + [("GET /same", 200, 99, json.dumps({f"k{i}": pairs[0][0] for i in range(12)}))]
    assert [r["endpoint"] for r in shapes.records(shapes.observe(spark.createDataFrame(rows, BODIES))).collect()] == ["GET /same"]


def test_deep_bodies_are_counted(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    objects = '{"a":' * 199 + "[]" + "}" * 199
    rows = [("GET /x", 200, i, t) for i, t in enumerate([deep(shapes.MAX_DEPTH), objects, deep(shapes.MAX_DEPTH + 1), '{"s":"' + "[" * 999 + '"}', deep(100_000), deep(100_000)[:-1], '"refused"'])]
    parts = shapes.observe(spark.createDataFrame(rows, BODIES))
    assert [r["n"] for r in shapes.refused(parts).collect()] == [3]
    assert shapes.nodes(parts).where("path = '$'").agg(F.sum("samples")).first()[0] == 4
    drawn = model.texts(model.observed(parts)).where("path = ''").collect()
    assert any("a: {" in r["text"] for r in drawn)
    assert shapes.nesting('"[[" [ {"]": [[]]} ]') == 4


def test_inflated_bodies(spark):
    plain, raw = b"body " * 5000, zlib.compressobj(wbits=-15)
    brotli = pa.Codec("brotli").compress(plain, asbytes=True)
    rows = [(brotli, "br"), (gzip.compress(plain), " GZIP"), (zlib.compress(plain), "deflate"), (raw.compress(plain) + raw.flush(), "deflate"), (plain, "identity"), (plain, None)]
    df = spark.createDataFrame([(bytearray(b), e) for b, e in rows], "b binary, e string")
    assert [bytes(r[0]) for r in df.select(store.decode_content(F.col("b"), F.col("e"))).collect()] == [plain] * 6
    bomb = [pa.Codec("brotli").compress(b"\0" * (8 << 20), asbytes=True), gzip.compress(b"\0" * (8 << 20)), zlib.compress(b"\0" * (8 << 20)), gzip.compress(plain)[:-9], b"\x1f\x8bno", brotli[:8]]
    kinds = ["br", "gzip", "deflate", "gzip", "gzip", "br"]
    df = spark.createDataFrame([(bytearray(b), e) for b, e in zip(bomb, kinds, strict=True)], "b binary, e string")
    assert [bytes(r[0]) for r in df.select(store.decode_content(F.col("b"), F.col("e"), 1 << 20)).collect()] == bomb
    edge = spark.createDataFrame([(bytearray(gzip.compress(b"x" * 100)), "gzip")], "b binary, e string")
    assert [len(edge.select(store.decode_content(F.col("b"), F.col("e"), n)).first()[0]) == 100 for n in (100, 99)] == [True, False]


def test_files_are_written_by_tasks(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other.txt").write_text("stays")
    df = spark.range(40).select(F.format_string("d%d/f%d.txt", F.col("id") % 3, "id").alias("path"), F.format_string("é %d", "id").alias("content")).repartition(5)
    assert len(files.write(df, str(tmp_path / "out"))) == 40
    assert (tmp_path / "out" / "d1" / "f7.txt").read_text() == "é 7" and (tmp_path / "out" / "other.txt").read_text() == "stays"
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 41 and not list((tmp_path / "out").glob(".*"))
    for bad in ("../x", "/etc/x", "a/../../x", "", "."):
        with pytest.raises(Exception, match="no path inside"):
            files.write(spark.createDataFrame([(bad, "x")], "path string, content string"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="two files"):
        files.write(spark.createDataFrame([("a", "x"), ("./a", "y")], "path string, content string").repartition(2), str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_json_nodes_in_batches(spark):
    S.register(spark)
    rows = [(i, t) for i, t in enumerate(['{"a":[1,"x"],"b":null}', None, "{broken", "[[1.5]]", '"2024-01-05"', "[" * 500 + "]" * 500])]
    spark.createDataFrame(rows, "id long, body string").createOrReplaceTempView("bodies")
    got = spark.sql("select id, n.* from bodies, lateral json_nodes(body) n").collect()
    want = [(i, *node) for i, t in rows if t and i not in (2, 5) for node in shapes.walk(t)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = spark.sql("select * from json_nodes_of(table(select id, body from bodies))")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted([(str(w[0]), *w[1:]) for w in want], key=str)


def test_a_union_of_one():
    assert trees.zod({"kind": "union", "variants": [{"kind": "primitive", "type": "boolean"}]}) == "z.boolean()"
