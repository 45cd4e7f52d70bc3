"""Exchanges as rows: two projections over the sample tables, and endpoints of exchanges.

An exchange has ord (arrival order), method, path, query text, status, content type and body.
Bodies stay JSON text: null is no JSON body, the text ``null`` is a JSON null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_as_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GET for each page, the authority taken off its URL."""
    p = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    d = p.select(F.col("page_id").alias("ord"), F.lit("GET").alias("method"), url.alias("url"))
    return d.select("*", S.path_only(F.col("url")).alias("path"))


def events_as_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of a small API made of events; bodies vary with event_id so that every rule has a case."""
    i, kind = F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    suffix = F.when(kind == "view", F.concat(F.lit("/views/"), text(i))).when(kind == "click", F.concat(F.lit("/clicks/"), text(i))).when(kind == "purchase", F.concat(F.lit("/orders/"), text(i))).otherwise("")
    value = F.when(i % 5 == 0, "").when(i % 7 == 0, ',"value":null').when(i % 11 == 0, F.concat(F.lit(',"value":"'), text(F.col("user_id")), F.lit('"')))
    value = value.otherwise(F.concat(F.lit(',"value":'), text(i % 97), F.when(i % 3 == 0, ".5").otherwise("")))
    tags = F.when(i % 4 == 0, ',"tags":[]').when(i % 4 == 1, ',"tags":["a"]').when(i % 4 == 2, ',"tags":["a",1]').otherwise("")
    at = F.when(i % 2 == 0, ',"at":"2024-01-05"').otherwise(',"at":"2024-01-05T10:00:00Z"')
    mail = F.concat(F.lit(',"mail":"u'), text(F.col("user_id")), F.lit('@example.com"'))
    body = F.concat(F.lit('{"id":'), text(i), F.lit(',"type":"'), kind, F.lit('"'), value, tags, at, mail, F.lit(',"props":'), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select(
        i.alias("ord"), F.when(kind == "signup", "POST").when(kind == "purchase", "PUT").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/users/"), text(F.col("user_id")), suffix).alias("path"),
        F.when(kind == "signup", 201).when(kind != "error", 200).when(F.col("user_id") % 2 == 0, 404).otherwise(500).alias("status"),
        F.when(i % 9 == 0, "application/problem+json").otherwise("application/json").alias("content_type"), body.alias("body"), "user_id", "ts",
        F.when(kind == "signup", F.concat(F.lit('{"name":"u'), text(F.col("user_id")), F.lit('"'), F.when(i % 3 == 0, ',"plan":"pro"').otherwise(""), F.lit("}"))).when(kind == "purchase", F.concat(F.lit('{"qty":'), text(i % 5), F.lit("}"))).alias("req_body"),
        F.concat(F.lit("/api/users/"), text(F.col("user_id")), suffix, F.when(kind == "view", F.concat(F.lit("?page="), text(i % 9), F.when(i % 2 == 0, "&sort=asc").otherwise(""))).otherwise("")).alias("url"),
    )


def with_endpoint(exchanges: DataFrame, force: tuple[str, ...] = ()) -> DataFrame:
    """Adds pattern, params and endpoint (``METHOD pattern``).

    The segments are a column of their own, so the pattern and the parameters are read from one computation of them.
    """
    d = spread(exchanges).withColumn("segments", S.path_segments(F.col("path"), force))
    d = d.withColumn("pattern", S.pattern_of(F.col("segments"))).withColumn("params", S.params_of(F.col("segments"))).drop("segments")
    return d.withColumn("endpoint", F.concat_ws(" ", F.upper("method"), "pattern"))
