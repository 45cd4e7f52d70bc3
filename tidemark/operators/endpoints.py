"""Endpoint aggregates.  First and last are by ``ord``, never by partition order; every aggregate is
partly computed by each task, and lists are bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept
from . import firsts

MAX_SAMPLES = 10


def endpoint_groups(x: DataFrame) -> DataFrame:
    return x.groupBy("method", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def status_counts(x: DataFrame) -> DataFrame:
    return x.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def param_values(x: DataFrame) -> DataFrame:
    return x.select("endpoint", "ord", F.explode("params").alias("p")).select("endpoint", "ord", "p.*")


def param_samples(x: DataFrame, limit: int = MAX_SAMPLES) -> DataFrame:
    """The first ``limit`` distinct values of each parameter in order of arrival; a task sends at most ``limit`` a parameter."""
    values = param_values(x).select("endpoint", "index", "value", F.col("ord").alias("first_ord"))
    return firsts.first_distinct(values, ["endpoint", "index"], "value", "first_ord", limit)


def param_first_format(x: DataFrame) -> DataFrame:
    return param_values(x).groupBy("endpoint", "index").agg(F.min_by("name", "ord").alias("name"), F.min_by("format", "ord").alias("format"))


def latest_sample(x: DataFrame) -> DataFrame:
    return x.where("body is not null").groupBy("endpoint", "status").agg(F.max_by("body", "ord").alias("sample"), F.max("ord").alias("ord"))


def dominant_content_type(x: DataFrame) -> DataFrame:
    """The most frequent content type; of equally frequent ones the first met."""
    counts = x.groupBy("endpoint", "status", "content_type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return counts.groupBy("endpoint", "status").agg(F.max_by("content_type", F.struct("n", -F.col("first_ord"))).alias("content_type"))


def exchange_positions(x: DataFrame, column: str = "ord", parts: int | None = None) -> DataFrame:
    """(endpoint, ord, ``column``, pos): the place of each exchange in its endpoint's list, from 0 without gaps.

    Exchanges are ranged by endpoint and order, so a hot endpoint lies in as many tasks as its size asks for; each task counts
    its own, and what the tasks before it have of the same endpoint is added: prefix sums over one row for each (task, endpoint).
    """
    named = [c for c in dict.fromkeys(("endpoint", "ord", column))]
    keys = ["endpoint", *[c for c in named if c != "endpoint"]]
    ranged = x.select(*named).repartitionByRange(parts, *keys) if parts else x.select(*named).repartitionByRange(*keys)
    ranged = kept(ranged.sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id()))
    counts = ranged.groupBy("endpoint", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("endpoint").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept(counts.select("endpoint", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("endpoint", "task").orderBy(*keys[1:])) - 1
    placed = ranged.withColumn("place", place).join(starts, ["endpoint", "task"])
    return placed.select(*named, (F.col("start") + F.col("place")).cast("long").alias("pos"))


def success_status(x: DataFrame) -> DataFrame:
    ok = F.when(F.col("status").between(200, 299), F.col("status"))
    return x.groupBy("endpoint").agg(F.coalesce(F.min(ok), F.min("status")).alias("status"))


def query_shape(x: DataFrame, parsed: DataFrame) -> DataFrame:
    """For each endpoint and query key: occurrences (exchanges with it), and whether it is optional, that
    is rarer than the endpoint's most frequent key; ``parsed`` has endpoint, ord, key, value, kind."""
    once = parsed.groupBy("endpoint", "ord", "key").agg(F.count(F.lit(1)).alias("k"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    keys = once.groupBy("endpoint", "key").agg(F.count(F.lit(1)).alias("seen"), F.max((F.col("k") > 1).cast("int")).alias("repeated"), F.min("lo").alias("least_kind"), F.max("hi").alias("last_kind"))
    most = keys.groupBy("endpoint").agg(F.max("seen").alias("most"))
    return keys.join(most, "endpoint").withColumn("optional", F.col("seen") < F.col("most")).drop("most")


def gen_summary(x: DataFrame) -> DataFrame:
    by = status_counts(x)
    return by.groupBy("endpoint").agg(F.sum("n").alias("samples"), F.array_join(F.transform(F.sort_array(F.collect_set("status")), lambda s: s.cast("string")), ",").alias("statuses"))
