"""The query catalogue over the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import claims, diff, emit, endpoints, model, reports, shapes, state
from ..sources import store
from ..sources import exchanges as X
from ..streaming import models
from ..tables import kept, shared_folder, together

Query = Callable[[SparkSession, str], DataFrame]


def _exp(s: SparkSession, d: str) -> DataFrame:
    return X.with_endpoint(X.pages_as_exchanges(s, d))


def _exe(s: SparkSession, d: str) -> DataFrame:
    return X.with_endpoint(X.events_as_exchanges(s, d))


def _obs(s: SparkSession, d: str) -> DataFrame:
    return shapes.observe(_exe(s, d).select("endpoint", "status", "ord", "body"))


def _variants(s: SparkSession, d: str) -> DataFrame:
    return model.observed(_obs(s, d))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The month's first half, and the second with an altered API, so that every rule has a case."""
    x = X.events_as_exchanges(s, d)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    n, user = F.col("ord").cast("string"), F.col("user_id").cast("string")
    swaps = [
        (F.lit(',"mail":"u'), F.lit(',"email":"u')), (F.lit('"type":"view"'), F.lit('"type":"peek"')), (F.lit('"at":"2024-01-05"'), F.lit('"at":"2024-01-05T11:00:00Z"')),
        (F.concat(F.lit('{"id":'), n, F.lit(",")), F.concat(F.lit('{"id":"'), n, F.lit('",'))), (F.concat(F.lit(',"value":"'), user, F.lit('"')), F.lit(',"value":true')),
    ]
    body = F.col("body")
    for old, new in swaps:
        body = F.replace(body, old, new)
    body = F.when(F.col("ord") % 6 == 0, F.regexp_replace(body, ',"props":.*$', ',"props":null}')).otherwise(body)
    view, click, error = (F.contains("path", F.lit("/views/")), F.contains("path", F.lit("/clicks/")), F.col("status") >= 400)
    b = x.where(F.col("ts") >= cut).withColumns(
        {
            "body": F.when(F.col("status") != 404, body), "status": F.when(F.col("status") == 500, 503).otherwise(F.col("status")), "method": F.when(F.col("method") == "PUT", "PATCH").otherwise(F.col("method")),
            "req_body": F.when(error, '{"x":1}').when(F.col("method") != "POST", F.col("req_body")), "url": F.when(view, F.col("path")).when(click, F.concat("path", F.lit("?ref=x"))).otherwise(F.col("url")),
            "path": F.replace("path", F.lit("/clicks/"), F.lit("/clicks/click-0000000000000000")),
        }
    )
    return X.with_endpoint(x.where(F.col("ts") < cut)), X.with_endpoint(b)


def _side_obs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(shapes.observe(x.select("endpoint", "status", "ord", "body")) for x in _sides(s, d))


def _side_models(s: SparkSession, d: str, shaped: bool = True) -> tuple[model.Model, model.Model]:
    a, b = _sides(s, d)
    return tuple(together(lambda: model.build(kept(a), "first half", shaped=shaped), lambda: model.build(kept(b), "second half", shaped=shaped)))


def drift(*kinds: str) -> Query:
    """The report's findings of some kinds, with the sentence that says what changed."""
    groups = {"endpoint-removed": "endpoints", "endpoint-added": "endpoints", "status-removed": "statuses", "status-added": "statuses", "params-changed": "params"}
    rules = sorted({groups.get(k, "shapes") for k in kinds})

    def run(s: SparkSession, d: str) -> DataFrame:
        found = diff.findings(*_side_models(s, d, "shapes" in rules), rules=rules)
        return found.where(F.col("kind").isin(*kinds)).select(*_TOLD)

    return run


_TOLD = ("severity", "kind", "endpoint", "status", "path", "message", "b_samples")


def drift_endpoint_added(s: SparkSession, d: str) -> DataFrame:
    """New endpoints, each with its exchanges; they aren't a finding's samples, of which the report gives none here."""
    a, b = _side_models(s, d, shaped=False)
    found = diff.findings(a, b, rules=["endpoints"]).where("kind = 'endpoint-added'").select(*_TOLD)
    return found.join(b.endpoints.select("endpoint", F.col("samples").alias("n_b")), "endpoint", "left")


def drift_statuses(s: SparkSession, d: str) -> DataFrame:
    """Statuses that one side has alone, with their exchanges there."""
    sides = _side_models(s, d, shaped=False)
    found = diff.findings(*sides, rules=["statuses"]).where("kind in ('status-removed', 'status-added')").select(*_TOLD)
    for side, n in zip(sides, ("n_a", "n_b"), strict=True):
        found = found.join(side.responses.select("endpoint", "status", F.col("count").alias(n)), ["endpoint", "status"], "left")
    return found


def scan_skip_corrupt(s: SparkSession, d: str) -> DataFrame:
    """A log of exchanges, a thirteenth of its lines cut short and a seventeenth blank, is written and scanned."""
    o = F.col("ord")
    line = F.concat(F.lit('{"id":"e'), o.cast("string"), F.lit('","request":{"method":"GET","path":"/x","query":{}},"response":{"status":'), F.col("status").cast("string"), F.lit(',"headers":{},"bodyJson":'), "body", F.lit("}}"))
    line = F.when(o % 13 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).when(o % 17 == 0, "  \t").otherwise(F.concat(F.lit(" \t "), line, F.lit(" ")))
    path = f"{shared_folder(s)}/log-{uuid.uuid4().hex}"
    X.events_as_exchanges(s, d).select(line.alias("value")).write.text(path)
    found = store.exchanges_of(store.read_lines(s, path))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n_kept"), F.count("res_json").alias("n_bodies"), F.count_distinct("ord").alias("n_places"))


def redact_headers(s: SparkSession, d: str) -> DataFrame:
    x = X.events_as_exchanges(s, d)
    key = F.when(F.col("ord") % 2 == 0, "X-API-Key").otherwise("X-Other")
    headers = F.map_from_arrays(F.array(F.lit("Authorization"), F.lit("Content-Type"), key), F.array(F.lit("Bearer x"), F.col("content_type"), F.concat(F.lit("k"), F.col("user_id").cast("string"))))
    h = x.select("ord", S.normalize_headers(headers).alias("h"))
    return h.select("ord", F.col("h")["authorization"].alias("authorization"), F.col("h")["content-type"].alias("content_type"), F.coalesce(F.try_element_at("h", F.lit("x-api-key")), F.try_element_at("h", F.lit("x-other"))).alias("last_key"))


def _parsed(x: DataFrame) -> DataFrame:
    q = x.select("endpoint", "ord", F.explode(S.parse_query(F.col("url"))).alias("q")).select("endpoint", "ord", "q.*")
    return q.withColumn("kind", S.coerce_query(F.col("value")))


def format_strings(s: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    cases = [
        F.concat(F.lit("123e4567-e89b-12d3-a456-4266141740"), two(i % 100)), F.concat(F.lit("2024-01-05T10:00:"), two(i % 60), F.lit("Z")), F.concat(F.lit("2024-01-"), two(i % 28 + 1)),
        F.concat(F.lit("u"), u, F.lit("@example.com")), F.concat(F.lit("https://example.com/"), i.cast("string")), F.lit("2024-01-05\n"), F.concat(F.lit("mailto://u"), u, F.lit("@x.y")), F.col("event_type"),
    ]
    value = F.get(F.array(*cases), (i % 8).cast("int"))
    return X.table(s, d, "events").select("event_id", S.format_mask(value).alias("fmt_mask"))


def singular(s: SparkSession, d: str) -> DataFrame:
    n = F.lower("n_name")
    words = F.array(n, F.concat(n, F.lit("s")), F.concat(F.substring(n, 1, 3), F.lit("ies")), F.lit("ies"), F.lit("s"))
    w = X.table(s, d, "nation").select(F.explode(words).alias("word")).distinct()
    return w.select("word", S.singularize(F.col("word")).alias("singular"))


def numeric_guard(s: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size").cast("string")
    cases = [z, F.concat(F.lit("0"), z), F.concat(z, F.lit(".5")), F.concat(z, F.lit(".50")), F.concat(F.lit("-"), z), F.col("p_brand")]
    v = X.table(s, d, "part").select(F.get(F.array(*cases), (F.col("p_partkey") % 6).cast("int")).alias("s")).distinct()
    return v.select("s", S.is_numeric_data(F.col("s")).alias("numeric"))


def record_bodies(s: SparkSession, d: str) -> DataFrame:
    """For each nation an object of 12 to 14 keys, alike where the nation's key is even."""
    k = F.col("n_nationkey")
    pair = lambda i: F.concat(F.lit('"e'), i.cast("string"), F.lit('":'), F.when((k % 2 == 1) & (i == 0), '"x"').otherwise(i.cast("string")))
    inner = F.array_join(F.transform(F.sequence(F.lit(0), (11 + k % 3).cast("int")), pair), ",")
    body = F.concat(F.lit('{"k'), k.cast("string"), F.lit('":{'), inner, F.lit("}}"))
    return X.table(s, d, "nation").select(F.lit("GET /nations").alias("endpoint"), F.lit(200).alias("status"), k.cast("long").alias("ord"), body.alias("body"))


def record_detection(s: SparkSession, d: str) -> DataFrame:
    """Dictionaries: each even nation's object.  The root, which has a key for each nation, is none: odd nations' shapes differ."""
    return shapes.records(shapes.observe(record_bodies(s, d)))


def collapsed_shapes(s: SparkSession, d: str) -> DataFrame:
    """The places left when dictionaries of objects are collapsed: all priorities' orders of one key space."""
    o = X.table(s, d, "orders").select(F.lit("GET /orders").alias("endpoint"), F.lit(200).alias("status"), (F.col("o_orderkey") % 40).cast("long").alias("k"), "o_orderkey", "o_orderstatus")
    entry = F.concat(F.lit('"o'), F.col("o_orderkey").cast("string"), F.lit('":{"status":"'), "o_orderstatus", F.lit('","lines":['), (F.col("o_orderkey") % 7).cast("string"), F.lit("]}"))
    bodies = o.groupBy("endpoint", "status", F.col("k").alias("ord")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("body"))
    found = model.observed(shapes.observe(bodies))
    return found.select(shapes.shown(F.col("path")).alias("path"), "kind", "type", F.array_join(F.sort_array("enum"), ",").alias("vals"))


def drift_endpoints(s: SparkSession, d: str) -> DataFrame:
    a, b = (x.groupBy("endpoint").agg(F.count(F.lit(1)).alias(n)) for x, n in zip(_sides(s, d), ("n_a", "n_b"), strict=True))
    return a.join(b, "endpoint", "full_outer")


def drift_unions(s: SparkSession, d: str) -> DataFrame:
    on = ["endpoint", "status", "path", "family"]
    a, b = (shapes.nodes(o).select(*on, F.col("samples").alias(n)) for o, n in zip(_side_obs(s, d), ("n_a", "n_b"), strict=True))
    return a.join(b, on, "full_outer").where("n_a is null or n_b is null")


def _found(s: SparkSession, d: str) -> DataFrame:
    return diff.findings(*_side_models(s, d))


def drift_findings(s: SparkSession, d: str) -> DataFrame:
    """The whole report's findings, requests, queries, bodies and union variants among them."""
    return _found(s, d).select("severity", "kind", "endpoint", "status", "path", "b_samples")


def drift_texts(s: SparkSession, d: str) -> DataFrame:
    """The report in order, with what each place was and is and a sentence."""
    return diff.in_order(_found(s, d)).drop("seq")


def drift_counters(s: SparkSession, d: str) -> DataFrame:
    a, b = _side_models(s, d, shaped=False)
    found = diff.findings(a, b, ignore_unmatched=True, rules=("endpoints", "statuses", "params"))
    return diff.summary(a, b, found).select("endpoints_compared", "endpoints_only_in_a", "endpoints_only_in_b")


def drift_summary(s: SparkSession, d: str) -> DataFrame:
    """How many findings of each severity and kind, and behind how many of them there are few samples."""
    return _found(s, d).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"))


def low_confidence(s: SparkSession, d: str) -> DataFrame:
    """Findings behind which there are few samples, by kind."""
    few = diff.low_confidence(F.col("b_samples"))
    return _found(s, d).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(few).alias("n_low"))


def drift_fail_on(s: SparkSession, d: str) -> DataFrame:
    """Whether a check at each level fails."""
    found = _found(s, d)
    return s.createDataFrame([(level, diff.at_least(found, level)) for level in diff.RANK], "level string, fails boolean")


def report_document(how: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        a, b = _side_models(s, d)
        found = diff.findings(a, b)
        return reports.plain(a, b, found) if how == "text" else reports.markdown(a, b, found, how)

    return run


def claim_entries() -> list[dict]:
    """What a client believes of the events' API; one claim can't be audited."""
    user = {"type": "object", "required": ["id", "type", "tags", "seen"], "properties": {"id": {"type": "integer"}, "type": {"enum": ["view", "click"]}, "tags": {"type": "array", "items": {"type": "string"}}, "seen": {"type": "string"}, "value": {}}}
    return [
        {"method": "get", "pattern": "/api/users/:userId/views/:viewId", "response": user}, {"method": "GET", "pattern": "/api/users/:userId/views/:viewId", "status": 304},
        {"method": "POST", "pattern": "/api/users/:userId", "status": 201, "response": {"type": "array"}, "request": {"type": "object", "properties": {}}},
        {"method": "GET", "pattern": "/api/users/:userId/clicks/:clickId", "response": {"type": "object", "properties": {"at": False}}},
    ]


def claims_drift(s: SparkSession, d: str) -> DataFrame:
    """Claims against what is observed; endpoints without claims are no findings."""
    claimed = claims.extract(s, claim_entries())
    found = diff.findings(claimed.model, model.build(kept(_exe(s, d)), "observed"), ignore_unmatched=True)
    return found.select("severity", "kind", "endpoint", "status", "path")


def claims_refused(s: SparkSession, d: str) -> DataFrame:
    """Claims on every response that was observed; those on errors have a field that no value fits and are refused."""
    seen = endpoints.status_counts(_exe(s, d)).withColumn("e", F.split("endpoint", " ", 2)).orderBy("endpoint", "status").collect()
    schema = lambda status: {"type": "object", "properties": {"at": False if status >= 400 else {"type": "string"}}}
    entries = [{"method": r["e"][0].lower(), "pattern": r["e"][1], "status": r["status"], "response": schema(r["status"])} for r in seen]
    return claims.extract(s, entries).not_auditable.select("endpoint", "slot")


def api_model(s: SparkSession, d: str) -> DataFrame:
    """Endpoints with their parameters, request, query and responses joined: a row for each response."""
    return _joined(model.build(kept(_exe(s, d)), "events"))


def _landed(s: SparkSession, d: str, batches: int) -> models.ModelFolder:
    """The state that a stream of the events, landed in some files out of order, leaves."""
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in models.LANDED.split(", ")]
    X.events_as_exchanges(s, d).withColumn("status", F.col("status").cast("int")).select(*columns).repartition(batches, F.xxhash64("ord")).write.parquet(f"{folder}/in")
    models.keep_model(models.landed(s, f"{folder}/in", max(1, batches // 2)), f"{folder}/model", f"{folder}/checkpoint").awaitTermination()
    return models.ModelFolder(s, f"{folder}/model")


def streamed_model(s: SparkSession, d: str) -> DataFrame:
    """The API model of a stream, its state merged batch after batch."""
    return _joined(_landed(s, d, 4).model("events"))


def streamed_enums(s: SparkSession, d: str) -> DataFrame:
    """Closed vocabularies of a stream's responses."""
    found = shapes.enums(_landed(s, d, 4).state().parts)
    return found.select("endpoint", "status", "path", "samples", F.array_join(F.sort_array(F.split("values", ",")), ",").alias("vals"))


def merged_model(s: SparkSession, d: str) -> DataFrame:
    """The API model of the states of three days' groups, gathered apart and merged."""
    x = kept(_exe(s, d))
    parts = together(*[lambda k=k: state.merged([state.gathered(x.where(F.dayofmonth("ts") % 3 == k))]) for k in range(3)])
    return _joined(model.of_state(state.merged(parts), "events"))


def _joined(m: model.Model) -> DataFrame:
    places = m.variants.groupBy("endpoint", "slot", "status").agg(F.count_distinct("path").alias("n"))
    slot = lambda name: places.where(F.col("slot") == name)
    params = m.params.groupBy("endpoint").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "name", "format"))), lambda p: F.concat_ws(":", p["name"], p["format"])), ",").alias("params"))
    d = m.responses.join(m.endpoints, "endpoint").join(params, "endpoint", "left").join(slot("response").select("endpoint", "status", F.col("n").alias("body_places")), ["endpoint", "status"], "left")
    d = d.join(slot("request").select("endpoint", F.col("n").alias("request_places")), "endpoint", "left").join(slot("query").select("endpoint", F.col("n").alias("query_places")), "endpoint", "left")
    return d.select("endpoint", "status", F.col("count").alias("n"), "content_type", "operation_id", "params", "body_places", "request_places", "query_places")


def request_samples(s: SparkSession, d: str) -> DataFrame:
    """The last request body of each endpoint."""
    x = _exe(s, d)
    return endpoints.latest_sample(x.drop("body").withColumnRenamed("req_body", "body")).select("endpoint", "status", "sample")


def generated(target: str) -> Query:
    return lambda s, d: emit.files(model.build(kept(_exe(s, d)), "events", "http://localhost"), [target], fixtures=target == "msw")


def _recorded(x: DataFrame) -> DataFrame:
    """Events' exchanges with the columns of a recording."""
    none = F.lit(None)
    empty = F.create_map().cast("map<string,array<string>>")
    columns = {"id": F.concat(F.lit("e"), F.col("ord").cast("string")), "started_at": F.col("ord"), "query": empty, "req_headers": F.create_map().cast("map<string,string>"), "req_text": none.cast("string"), "req_json": F.col("req_body")}
    return x.withColumns(columns | {"res_headers": F.create_map(F.lit("content-type"), F.col("content_type")), "res_text": none.cast("string"), "res_json": F.col("body"), "duration_ms": F.lit(1).cast("long")})


def recording_log(s: SparkSession, d: str) -> DataFrame:
    """All events appended to one recording in five batches, one of them twice, and read back: places have no gaps within the log."""
    found = store.Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    x = _recorded(X.events_as_exchanges(s, d))
    for k in (0, 1, 2, 3, 4, 2):
        found.append("all", x.where(F.col("ord") % 5 == k), f"batch-{k}")
    rows = found.load("all").withColumn("batch", F.substring("id", 2, 20).cast("long") % 5)
    return rows.groupBy("batch", "status").agg(F.count(F.lit(1)).alias("n"), F.count("req_json").alias("n_requests"), F.min("ord").alias("first_place"), F.max("ord").alias("last_place"))


def recording_catalog(s: SparkSession, d: str) -> DataFrame:
    """Recordings of the first three days of events, written to a store and listed."""
    found = store.Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    x = X.events_as_exchanges(s, d).where("to_date(ts) <= date'2024-01-03'").withColumn("day", F.dayofmonth("ts"))
    for day in (1, 2, 3):
        found.init(f"day-{day}", "http://events")
        found.append(f"day-{day}", _recorded(x.where(F.col("day") == day)), "all")
    return found.list().select("name", "target", F.col("exchangeCount").alias("n"))


def array_elements(s: SparkSession, d: str) -> DataFrame:
    on = ["endpoint", "status", "path"]
    n = shapes.nodes(_obs(s, d))
    items = n.where(F.col("path").endswith("[]")).groupBy(*on).agg(F.sum("samples").alias("elements")).withColumn("path", F.expr("left(path, length(path) - 2)"))
    return n.where("family = 'array'").select(*on, F.col("samples").alias("arrays")).join(items, on, "left").withColumn("elements", F.coalesce("elements", F.lit(0).cast("long")))


def enum_values(s: SparkSession, d: str) -> DataFrame:
    return shapes.enums(_obs(s, d)).select("endpoint", "status", "path", "samples", F.array_join(F.sort_array(F.split("values", ",")), ",").alias("vals"))


QUERIES: dict[str, Query] = {
    "scan_skip_corrupt": scan_skip_corrupt,
    "filter_include_exclude": lambda s, d: X.events_as_exchanges(s, d).where(S.should_record(F.col("path"), ("/api/users/1", "/api/users/2"), ("/api/users/11",))).select("ord", "path"),
    "redact_headers": redact_headers,
    "body_decode_cap": lambda s, d: X.events_as_exchanges(s, d).select("ord", S.decode_body(F.col("body"), 128).alias("b")).select("ord", "b.text", F.col("b.json").isNotNull().alias("parsed")),
    "path_only": lambda s, d: X.pages_as_exchanges(s, d).select("ord", "path"),
    "parse_query_multimap": lambda s, d: _parsed(_exp(s, d)).groupBy("ord", "key", "value").agg(F.count(F.lit(1)).alias("n")),
    "classify_segments": lambda s, d: X.pages_as_exchanges(s, d).select(F.explode(F.slice(F.split("path", "/"), F.lit(2), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))).alias("seg")).distinct().select("seg", S.classify_segment(F.col("seg")).alias("kind")),
    "singularize": singular,
    "normalize_path": lambda s, d: _exp(s, d).select("path", "pattern").union(_exe(s, d).select("path", "pattern")).distinct(),
    "operation_name": lambda s, d: _exe(s, d).select("method", "pattern").distinct().withColumn("operation_id", S.operation_name(F.col("method"), F.col("pattern"))),
    "coerce_query_values": lambda s, d: _parsed(_exp(s, d)).select("value", "kind").distinct(),
    "detect_formats": format_strings,
    "numeric_string_guard": numeric_guard,
    "openapi_paths": lambda s, d: _exe(s, d).select("pattern").distinct().withColumn("openapi_path", S.openapi_path(F.col("pattern"))),
    "endpoint_groups": lambda s, d: endpoints.endpoint_groups(_exp(s, d)),
    "status_counts": lambda s, d: endpoints.status_counts(_exe(s, d)),
    "exchange_ids": lambda s, d: _exp(s, d).select("endpoint", "ord"),
    "exchange_positions": lambda s, d: endpoints.exchange_positions(_exe(s, d)),
    "param_samples_topk": lambda s, d: endpoints.param_samples(_exe(s, d)).select("endpoint", F.col("index").cast("long").alias("idx"), "value", F.col("rank").cast("long").alias("rank")),
    "param_first_format": lambda s, d: endpoints.param_first_format(_exe(s, d)).withColumn("idx", F.col("index").cast("long")).drop("index"),
    "latest_sample": lambda s, d: endpoints.latest_sample(_exe(s, d)),
    "dominant_content_type": lambda s, d: endpoints.dominant_content_type(_exe(s, d)),
    "query_shape": lambda s, d: endpoints.query_shape(_exp(s, d), _parsed(_exp(s, d))),
    "distinct_raw_paths": lambda s, d: X.events_as_exchanges(s, d).agg(F.count_distinct(F.concat_ws(" ", "method", "path")).alias("n")),
    "success_status": lambda s, d: endpoints.success_status(_exe(s, d)),
    "gen_summary": lambda s, d: endpoints.gen_summary(_exe(s, d)),
    "endpoints_sorted": lambda s, d: _exp(s, d).select("pattern", "method").distinct().orderBy("pattern", "method"),
    "infer_json_nodes": lambda s, d: shapes.observations(_exe(s, d).select("endpoint", "status", "ord", "body")).groupBy("ord", "path", "family").agg(F.count(F.lit(1)).alias("n")),
    "shape_nodes": lambda s, d: shapes.nodes(_obs(s, d)).drop("first_ord", "first_pos"),
    "numeric_widening": lambda s, d: shapes.nodes(_obs(s, d)).where("family = 'num'").select("endpoint", "status", "path", F.when(F.col("all_int"), "integer").otherwise("number").alias("type")),
    "format_intersection": lambda s, d: shapes.nodes(_obs(s, d)).where("family = 'string'").select("endpoint", "status", "path", "fmt_mask"),
    "array_element_merge": array_elements,
    "optional_fields": lambda s, d: shapes.fields(_obs(s, d)),
    "union_variants": lambda s, d: shapes.unions(_obs(s, d)).where("k > 1").select("endpoint", "status", "path", "families"),
    "nullable_fields": lambda s, d: shapes.unions(_obs(s, d)).where("nullable").select("endpoint", "status", "path"),
    "enum_detection": enum_values,
    "record_detection": record_detection,
    "drift_endpoints": drift_endpoints,
    "drift_endpoint_removed": drift("endpoint-removed"),
    "drift_endpoint_added": drift_endpoint_added,
    "drift_statuses": drift_statuses,
    "drift_fields": drift("field-removed", "field-added", "optionality-changed"),
    "drift_params": drift("params-changed"),
    "drift_nullability": drift("nullability-changed"),
    "drift_type_matrix": drift("type-changed"),
    "drift_enums": drift("enum-values-changed"),
    "drift_formats": drift("format-changed"),
    "drift_unions": drift_unions,
    "drift_summary": drift_summary,
    "drift_report_sorted": lambda s, d: diff.in_order(_found(s, d)).select(*_TOLD),
    "drift_fail_on": drift_fail_on,
    "render_types": lambda s, d: emit.render(_variants(s, d), "types"),
    "render_zod": lambda s, d: emit.render(_variants(s, d), "zod"),
    "render_json_schema": lambda s, d: emit.render(_variants(s, d), "json-schema"),
    "render_spark_ddl": lambda s, d: emit.render(_variants(s, d), "spark-ddl"),
    "render_openapi": lambda s, d: emit.openapi(_exe(s, d), _variants(s, d)),
    "recording_catalog": recording_catalog,
    "recording_log": recording_log,
    "api_model": api_model,
    "streamed_model": streamed_model,
    "streamed_enums": streamed_enums,
    "merged_model": merged_model,
    "request_samples": request_samples,
    "collapsed_shapes": collapsed_shapes,
    "json_content_type": lambda s, d: X.events_as_exchanges(s, d).select("ord", S.is_json_type(F.when(F.col("ord") % 4 == 0, "text/plain").when(F.col("ord") % 4 == 1, "Application/JSON; x=1").when(F.col("ord") % 4 == 2, F.col("content_type"))).alias("is_json")),
    "strip_hop_by_hop": lambda s, d: X.events_as_exchanges(s, d).select("ord", F.array_join(F.sort_array(F.map_keys(S.strip_hop_by_hop(F.create_map(F.when(F.col("ord") % 2 == 0, "Connection").otherwise("X-A"), F.lit("1"), F.lit("Proxy-Any"), F.lit("2"), F.when(F.col("ord") % 3 == 0, "TE").otherwise("Accept"), F.lit("3"))))), ",").alias("names")),
    "query_bodies": lambda s, d: _exp(s, d).select("ord", S.query_json(F.col("url")).alias("query")),
    "type_names": lambda s, d: _exe(s, d).select("method", "pattern").distinct().withColumn("type_name", S.type_name(F.col("method"), F.col("pattern"))),
    "drift_findings": drift_findings,
    "drift_texts": drift_texts,
    "drift_counters": drift_counters,
    "drift_low_confidence": low_confidence,
    "report_markdown": report_document("en"),
    "report_markdown_ko": report_document("ko"),
    "report_text": report_document("text"),
    "claims_drift": claims_drift,
    "claims_refused": claims_refused,
    "gen_types_file": generated("ts"),
    "gen_zod_file": generated("zod"),
    "gen_mock_files": generated("msw"),
    "gen_openapi_file": generated("openapi"),
    "gen_model_file": generated("model"),
    "gen_table": lambda s, d: reports.gen_table(model.build(kept(_exe(s, d)), "events")),
    "render_mock_handlers": lambda s, d: emit.mock_handlers(_exe(s, d), endpoints.latest_sample(_exe(s, d))),
}
