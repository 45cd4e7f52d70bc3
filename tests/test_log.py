"""The append log: side by side appends, gapless order, splits, streams and failures."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from tidemark.sources import log, store



def exchanges(spark, lo, hi, tag="e"):
    null = F.lit(None)
    none = null.cast("string")
    return spark.range(lo, hi).select(
        F.col("id").alias("ord"), F.format_string(f"{tag}%d", "id").alias("id"), F.col("id").alias("started_at"), F.lit("GET").alias("method"), F.lit("/x").alias("url"), F.lit("/x").alias("path"),
        null.cast("map<string,array<string>>").alias("query"), null.cast("map<string,string>").alias("req_headers"), none.alias("req_text"), none.alias("req_json"), F.lit(200).alias("status"),
        null.cast("map<string,string>").alias("res_headers"), none.alias("res_text"), F.lit('{"a":1}').alias("res_json"), F.lit(1).cast("long").alias("duration_ms"),
    )


def test_appends_side_by_side(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    kept.init("r", "http://a")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: kept.append("r", exchanges(spark, k * 10, k * 10 + 7).coalesce(2)), range(20)))
    rows = kept.load("r").select("ord", "id").orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(140)) and len({r["id"] for r in rows}) == 140
    assert kept.meta("r")["exchangeCount"] == 140 and kept.list().first()["exchangeCount"] == 140
    ids = [int(r["id"][1:]) for r in rows]
    assert all(ids[i : i + 7] == list(range(ids[i], ids[i] + 7)) for i in range(0, 140, 7))  # an append stays together, in its order
    assert [e["seq"] for e in kept.log("r").entries()] == list(range(20))


def test_a_batch_counts_once_and_failures_leave_nothing(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: kept.append("r", exchanges(spark, 0, 5), "same"), range(4)))
    broken = exchanges(spark, 5, 9).withColumn("id", F.when(F.col("ord") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        kept.append("r", broken, "bad")
    kept.append("r", exchanges(spark, 9, 11), "more")
    assert kept.load("r").count() == kept.meta("r")["exchangeCount"] == 7 and len(kept.log("r").entries()) == 2
    (tmp_path / "r" / "data" / "orphan").mkdir()
    assert kept.log("r").vacuum() == ["orphan"] and kept.load("r").count() == 7


def test_splits_have_gapless_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "MARK", 64)
    folder, texts = str(tmp_path / "r"), [f"line {i} " + "é" * (i % 40) for i in range(300)] + ["", None, "two\nlines"]
    out = log.Writer(folder, "b")

    class Context:
        def partitionId(self):
            return 3

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Context()))
    message = out.write(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    out.commit([message])
    planned = log.splits(log.Log(folder).entries())
    assert len(planned) > 50
    got = [(o, t) for s in planned for b in log._read(folder, s) for o, t in zip(b["ord"].to_pylist(), b["text"].to_pylist(), strict=True)]
    assert got == [(i, (t or "").replace("\n", " ")) for i, t in enumerate(texts)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    kept, out = store.Store(spark, str(tmp_path / "s")), str(tmp_path / "out")
    for turn in range(2):
        kept.append("r", exchanges(spark, turn * 50, turn * 50 + 50))
        kept.append("r", exchanges(spark, turn * 50 + 1000, turn * 50 + 1010))
        kept.stream("r").select("ord", "id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(120)
        rows = spark.read.parquet(out).orderBy("ord").collect()
        assert [r["ord"] for r in rows] == list(range(60 * (turn + 1))) and len({r["id"] for r in rows}) == len(rows)


def test_a_plain_file_is_taken_in(spark, tmp_path):
    (tmp_path / "r").mkdir()
    line = {"id": "old", "startedAt": 5, "request": {"method": "GET", "url": "/a", "path": "/a"}, "response": {"status": 200, "headers": {}}}
    (tmp_path / "r" / "exchanges.ndjson").write_text(json.dumps(line) + "\n{broken\n\n" + json.dumps(line | {"id": "older"}) + "\n")
    (tmp_path / "r" / "meta.json").write_text(json.dumps({"name": "r", "target": "t", "createdAt": 1, "updatedAt": 2, "exchangeCount": 2}))
    kept = store.Store(spark, str(tmp_path))
    assert [r["id"] for r in kept.load("r").orderBy("ord").collect()] == ["old", "older"]
    kept.append("r", exchanges(spark, 0, 2, "new"))
    assert [r["id"] for r in kept.load("r").orderBy("ord").collect()] == ["old", "older", "new0", "new1"]


def test_one_read_of_the_data(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    kept.append("r", exchanges(spark, 0, 10))
    plan = kept.lines("r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan and "Window" not in plan
