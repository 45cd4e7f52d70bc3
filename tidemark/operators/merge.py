"""Merging two models whose recordings are gone: shapes place by place, counts added, as if both had been seen by one model.

Unlike states, which merge before dictionaries and vocabularies are found, these are finished shapes, observed or claimed.  Rows of both sides
meet by place and family of value; a merge is an aggregate of at most a few rows.  Rules: numbers widen, formats intersect, a
vocabulary that meets another value of its type opens, an unknown gives way, a dictionary stays one only where it meets another and
otherwise counts as an object without fields, and a field that one of two objects lacks is optional.  A count that only one side
has is added to 1; where neither has one there is none.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept
from .model import VARIANTS, Model
from .shapes import SEP, SHAPE, ancestors

_ON = [*SHAPE, "path"]


def _one(path: Column) -> Column:
    """A place without the marks that tell a union's second object or array apart: in a merge they are one."""
    return F.regexp_replace(path, SEP + r"\|[0-9]+", "")


def _side(v: DataFrame, side: int) -> DataFrame:
    family = F.when(F.col("kind").isin("object", "record"), "object").when(F.col("kind") != "primitive", F.col("kind")).when(F.col("type").isin("integer", "number"), "num").otherwise(F.col("type"))
    return v.withColumns({"path": _one(F.col("path")), "parent": _one(F.col("parent")), "family": family, "side": F.lit(side)})


def _counts(column: str) -> Column:
    """The sum, an absent count being 1, or none where all are absent."""
    return F.when(F.count(column) > 0, F.sum(F.coalesce(column, F.lit(1)))).cast("long")


def variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """``model.VARIANTS`` of both sides merged; shapes and places of one side stay as they are."""
    rows = kept(_side(a, 0).unionByName(_side(b, 1)))
    turned = rows.groupBy(*_ON).agg(F.bool_or(F.col("kind") == "object").alias("o"), F.bool_or(F.col("kind") == "record").alias("r")).where("o and r").select(*SHAPE, F.concat("path", F.lit(SEP + "{}")).alias("up"))
    below = rows.select(*_ON).distinct().withColumn("up", F.explode(ancestors(F.col("path")))).join(turned, [*SHAPE, "up"], "left_semi").select(*_ON).distinct()
    rows = kept(rows.join(below, _ON, "left_anti"))
    known = rows.where("kind <> 'unknown'").select(*_ON).distinct().withColumn("known", F.lit(True))
    first = F.struct("side", "variant")
    met = F.count(F.lit(1)) > 1
    no_formats = F.array().cast("array<string>")
    common = F.aggregate(F.collect_list(F.coalesce("formats", no_formats)), F.max_by("formats", -F.col("side")), lambda x, y: F.array_intersect(x, y))
    one = rows.join(known, _ON, "left").where("kind <> 'unknown' or known is null").groupBy(*_ON, "family").agg(
        F.when(F.bool_and(F.col("kind") == "record"), "record").when(F.col("family") == "object", "object").otherwise(F.first("kind")).alias("kind"),
        F.when(F.col("family") == "num", F.when(F.bool_and(F.col("type") == "integer"), "integer").otherwise("number")).otherwise(F.first("type")).alias("type"),
        F.when(met, F.nullif(F.coalesce(common, no_formats), no_formats)).otherwise(F.first("formats")).alias("formats"), F.when(~met, F.first("enum")).alias("enum"),
        _counts("samples").alias("samples"), F.min(first).alias("order"),
    )
    # a place is a field of as many objects as its parent has sides
    places = rows.groupBy(*_ON, "side").agg(F.first("parent").alias("parent"), F.first("key").alias("key"), F.max("seen").alias("seen"), F.bool_or("optional").alias("optional"), F.min("place").alias("place"))
    holders = rows.where("family = 'object'").select(*SHAPE, F.col("path").alias("parent"), "side").distinct().groupBy(*SHAPE, "parent").agg(F.count(F.lit(1)).alias("holders"))
    field = places.groupBy(*_ON).agg(F.first("parent").alias("parent"), F.first("key").alias("key"), _counts("seen").alias("seen"), F.bool_or("optional").alias("optional"), F.count(F.lit(1)).alias("sides"), F.min(F.struct("side", "place")).alias("at"))
    field = field.join(holders, [*SHAPE, "parent"], "left")
    lacking = F.col("key").isNotNull() & (F.col("sides") < F.coalesce("holders", F.lit(0)))
    by_key, by_place = Window.partitionBy(*SHAPE, "parent").orderBy("at", "path"), Window.partitionBy(*_ON).orderBy("order")
    field = field.select(*_ON, "parent", "key", "seen", (F.col("optional") | lacking).alias("optional"), (F.dense_rank().over(by_key) - 1).alias("place"))
    found = one.withColumn("variant", F.row_number().over(by_place) - 1).join(field, _ON).withColumn("copy", F.lit(0))
    return kept(found.select(*[c.split()[0] for c in VARIANTS.split(", ")]))


def models(a: Model, b: Model) -> Model:
    """One model of two: endpoints' and responses' counts added, samples, names and formats of the side that has them first."""
    both = lambda name: getattr(a, name).withColumn("side", F.lit(0)).unionByName(getattr(b, name).withColumn("side", F.lit(1)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("side"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("side"))).alias(c)
    ends = both("endpoints").groupBy("endpoint", "method", "pattern").agg(_counts("samples").alias("samples"), last("request_sample"), first("operation_id"), first("type_name"))
    responses = both("responses").groupBy("endpoint", "status").agg(_counts("count").alias("count"), last("sample_body"), first("content_type"))
    listed = F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("side", "samples"))), lambda x: x["samples"]))), 1, 10)
    params = both("params").groupBy("endpoint", "index").agg(first("name"), first("format"), listed.alias("samples"))
    return replace(a, endpoints=kept(ends), responses=kept(responses), params=kept(params), variants=variants(a.variants, b.variants))
