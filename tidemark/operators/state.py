"""What a model is read from, as tables that merge: batches, days or streams of exchanges can be added up in any order.

Every column is a sum, a minimum or maximum by arrival, a bit operation, or a list of bounded length, so the merge of two
states is the state of both inputs.  A state's size follows distinct endpoints, parameters, content types and places of
bodies, not the number of exchanges.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..tables import kept, together
from . import endpoints, firsts, shapes

_PARAM = ["endpoint", "index"]
_PLACE = [*shapes.SHAPE, "path", "parent", "key", "depth", "family"]


@dataclass(frozen=True)
class State:
    """``endpoints`` (with the last request body), ``params``, ``samples`` (first values of parameters), ``responses`` (with the last
    body), ``types`` (content types) and ``parts`` (places of bodies, with the values of closed vocabularies)."""

    endpoints: DataFrame
    params: DataFrame
    samples: DataFrame
    responses: DataFrame
    types: DataFrame
    parts: DataFrame


NAMES = [f.name for f in fields(State)]


def bodies(exchanges: DataFrame) -> DataFrame:
    """(endpoint, slot, status, ord, body) of the responses, requests and queries of ``exchanges``
    (endpoint, status, ord, body and, where there are, req_body and url)."""
    out = exchanges.select("endpoint", F.lit("response").alias("slot"), "status", "ord", "body")
    if "req_body" in exchanges.columns:
        out = out.union(exchanges.where("req_body is not null").select("endpoint", F.lit("request"), F.lit(-1), "ord", "req_body"))
    if "url" in exchanges.columns:
        query = exchanges.select("endpoint", "ord", S.query_json(F.col("url")).alias("query")).where("query <> '{}'")
        out = out.union(query.select("endpoint", F.lit("query"), F.lit(-1), "ord", "query"))
    return out


def gathered(x: DataFrame) -> State:
    """The state of ``x``, its parts as the tasks give them (method, pattern, endpoint, params, status, ord, body, content_type; req_body and url where there are)."""
    sent = F.col("req_body") if "req_body" in x.columns else F.lit(None).cast("string")
    order = F.col("ord").cast("long")
    ends = x.select("endpoint", "method", "pattern", F.lit(1).cast("long").alias("n"), F.when(sent.isNotNull(), order).alias("request_ord"), sent.alias("request_sample"))
    values = endpoints.param_values(x).select(*_PARAM, F.col("ord").cast("long").alias("first_ord"), "name", "format", "value")
    answers = x.select("endpoint", F.col("status").cast("int"), F.lit(1).cast("long").alias("n"), F.when(F.col("body").isNotNull(), order).alias("body_ord"), F.col("body").alias("sample_body"))
    types = x.select("endpoint", F.col("status").cast("int"), "content_type", F.lit(1).cast("long").alias("n"), order.alias("first_ord"))
    samples = firsts.partly(values, _PARAM, "value", "first_ord", endpoints.MAX_SAMPLES)
    return _added(State(ends, values.drop("value"), samples, answers, types, shapes.walked(bodies(x))))


def _added(s: State) -> State:
    """The tables with one row for each key, but for the parts."""
    ends = s.endpoints.groupBy("endpoint", "method", "pattern").agg(F.sum("n").alias("n"), F.max("request_ord").alias("request_ord"), F.max_by("request_sample", "request_ord").alias("request_sample"))
    params = s.params.groupBy(*_PARAM).agg(F.min("first_ord").alias("first_ord"), F.min_by("name", "first_ord").alias("name"), F.min_by("format", "first_ord").alias("format"))
    samples = firsts.merged(s.samples, _PARAM, "value", "first_ord", endpoints.MAX_SAMPLES).drop("rank")
    responses = s.responses.groupBy("endpoint", "status").agg(F.sum("n").alias("n"), F.max("body_ord").alias("body_ord"), F.max_by("sample_body", "body_ord").alias("sample_body"))
    types = s.types.groupBy("endpoint", "status", "content_type").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    return State(ends, params, samples, responses, types, s.parts)


def added_parts(parts: DataFrame, most: int = shapes.ENUM_MAX) -> DataFrame:
    """``shapes.PARTS`` with one row for each (place, kind of value).

    A place whose values are more than ``most``, or were already in one part, is open and lists none, so no list grows.
    """
    parts = kept(parts)
    one = parts.groupBy(*_PLACE).agg(
        F.sum("n").alias("n"), F.bool_and("all_int").alias("all_int"), F.bit_and("fmt_mask").cast("int").alias("fmt_mask"),
        F.min(F.struct("first_ord", "first_pos")).alias("first"), F.bool_or("open").alias("open"),
    )
    on = [*shapes.SHAPE, "path"]
    strings = parts.where("family = 'string'")
    shut = strings.groupBy(*on).agg(F.bool_or("open").alias("any")).where("not any").select(*on)
    values = strings.join(shut, on, "left_semi").select(*on, F.explode("vals").alias("x"))
    values = values.groupBy(*on, F.col("x.v").alias("v")).agg(F.sum("x.n").alias("n"), F.min(F.struct(F.col("x.ord").alias("ord"), F.col("x.pos").alias("pos"))).alias("at"))
    few = values.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most + 1).select(*on)
    item = F.struct("v", "n", F.col("at.ord").alias("ord"), F.col("at.pos").alias("pos"))
    listed = values.join(few, on, "left_semi").groupBy(*on).agg(F.sort_array(F.collect_list(item)).alias("vals"))
    joined = one.join(listed.withColumn("family", F.lit("string")), [*on, "family"], "left")
    string = F.col("family") == "string"
    return joined.select(
        *_PLACE, "n", "all_int", "fmt_mask", F.col("first.first_ord").alias("first_ord"), F.col("first.first_pos").alias("first_pos"), "vals",
        (string & (F.col("open") | F.col("vals").isNull())).alias("open"),
    )


def merged(states: list[State]) -> State:
    """The state of all that the given ones have seen."""
    s = _added(State(**{name: reduce(DataFrame.unionByName, [getattr(s, name) for s in states]) for name in NAMES}))
    return replace(s, parts=added_parts(s.parts))


def read(spark, folder: str) -> State:
    return State(**{name: spark.read.parquet(f"{folder}/{name}") for name in NAMES})


def write(state: State, folder: str) -> None:
    together(*[lambda n=name: getattr(state, n).write.mode("overwrite").parquet(f"{folder}/{n}") for name in NAMES])
