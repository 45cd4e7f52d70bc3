"""Merged and streamed states against one batch over everything."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import model, shapes, state
from tidemark.sources import exchanges as X
from tidemark.streaming import models


def exchanges(seed=3, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user = r.choice(["ann", "bob", "cid"])
        body = {"id": i, "who": user, "kind": r.choice(["a", "b"]), "free": f"w{i}", "nine": f"n{r.randint(0, 8)}", "eight": f"n{r.randint(0, 7)}", "all": {f"k{k}": {"n": k, "s": r.choice(["on", "off"])} for k in range(i % 9, i % 9 + 12)}}
        if r.random() < 0.3:
            body["maybe"] = r.choice([None, 1, 2.5, "x", [1], ["y"], {"a": None}])
        text = None if r.random() < 0.1 else json.dumps(body)
        sent = json.dumps({"name": user}) if r.random() < 0.4 else None
        path = r.choice(["/users/{}", "/users/{}/posts/77", "/health"]).format(r.randint(1, 40))
        rows.append((i, r.choice(["GET", "POST"]), path, path + r.choice(["", "?page=1", "?page=2&sort=asc"]), r.choice([200, 200, 404]), r.choice(["application/json", "text/plain"]), text, sent))
    return rows


def tables(m):
    plain = lambda df: sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect()))
    return {name: plain(getattr(m, name)) for name in ("endpoints", "params", "responses", "variants")}


@pytest.fixture(scope="module")
def whole(spark):
    return tables(model.build(X.with_endpoint(spark.createDataFrame(exchanges(), models.LANDED)), "m"))


def test_any_split_and_order(spark, whole):
    rows, r = exchanges(), random.Random(1)
    r.shuffle(rows)
    cuts = sorted(r.sample(range(1, len(rows)), 2))
    parts = [state.gathered(X.with_endpoint(spark.createDataFrame(rows[a:b], models.LANDED))) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    assert tables(model.of_state(state.merged([parts[2], state.merged([parts[0], parts[1]])]), "m")) == whole


def test_stream_equals_batch(spark, whole, tmp_path):
    rows = exchanges()
    random.Random(9).shuffle(rows)
    out, seen = str(tmp_path / "model"), models.ModelFolder(spark, str(tmp_path / "model"))
    for turn in range(2):  # the second run goes on where the first ended
        for k in range(2):
            spark.createDataFrame(rows[turn * 2 + k :: 4], models.LANDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        models.keep_model(models.landed(spark, str(tmp_path / "in"), 1), out, str(tmp_path / "cp")).awaitTermination(300)
    assert seen.versions() == [2, 3] and tables(seen.model("m")) == whole


def test_a_repeated_batch_counts_once(spark, tmp_path):
    df = X.with_endpoint(spark.createDataFrame(exchanges(n=12), models.LANDED))
    kept = models.ModelFolder(spark, str(tmp_path / "model"))
    with pytest.raises(FileNotFoundError):
        kept.model()
    kept.add(df.where("ord < 7"), 0)
    kept.add(df.where("ord >= 7"), 1)
    (tmp_path / "model" / "v=1" / "done").unlink()  # as if it had failed before its end
    assert kept.versions() == [0]
    kept.add(df.where("ord >= 7"), 1)
    kept.add(df.where("ord >= 7"), 1)
    assert kept.state().endpoints.agg(F.sum("n")).first()[0] == 12 and kept.versions() == [0, 1]


def test_lists_stay_bounded(spark):
    rows = [("GET /x", "response", 200, i, json.dumps({"s": f"v{i % 300}", "t": f"v{i % 8}"})) for i in range(900)]
    df = spark.createDataFrame(rows, "endpoint string, slot string, status int, ord long, body string")
    one = state.added_parts(shapes.walked(df.where("ord < 450")))
    both = state.added_parts(one.union(state.added_parts(shapes.walked(df.where("ord >= 450")))))
    got = {r["key"]: r for r in both.where("family = 'string'").collect()}
    assert got["s"]["open"] and got["s"]["vals"] is None and not got["t"]["open"] and len(got["t"]["vals"]) == 8
    assert both.agg(F.max(F.size("vals"))).first()[0] <= shapes.ENUM_MAX + 1
