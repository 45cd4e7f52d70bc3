"""The model of an API as tables: endpoints, path parameters, responses, and the variants of all shapes.

``variants`` is the table that emitters and drift read: a row for each kind of value that a place of a shape (response
body by status, request body, or query) can take.  Observed bodies and claims give the same columns, so
either can be a side of a comparison.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import scalars as S
from ..tables import kept, together
from . import shapes, state, trees

SHAPE, SEP = shapes.SHAPE, shapes.SEP
VARIANTS = (
    "endpoint string, slot string, status int, path string, parent string, key string, kind string, type string, formats array<string>, "
    "enum array<string>, samples long, seen long, optional boolean, place int, variant int, copy int"
)
TEXTS = "endpoint string, slot string, status int, path string, variant int, text string, core_text string, whole_text string"


@dataclass(frozen=True)
class Options:
    """What a model is built with."""

    force: tuple[str, ...] = ()
    enum_max: int = shapes.ENUM_MAX
    enum_min: int = shapes.ENUM_MIN
    record_keys: int = shapes.RECORD_KEYS


@dataclass(frozen=True)
class Model:
    """Tables of one API.  ``variants`` has all shapes; the others have a row for each endpoint, parameter and response."""

    name: str
    target: str
    endpoints: DataFrame
    params: DataFrame
    responses: DataFrame
    variants: DataFrame
    generated_at: int = 0


#: Lanes of 32 bits that a digest is cut into where digests of a set of any size are added up.
LANES = 8


def _digest(*parts) -> Column:
    """SHA-256 of the parts, each preceded by its length so that no two lists of parts read alike."""
    texts = [F.coalesce((F.lit(x) if isinstance(x, str) else x).cast("string"), F.lit("\x00")) for x in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def _lane(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _kids(positions: DataFrame) -> DataFrame:
    """For each object or array: how many keys it has, their least and greatest signature, the first key, and ``all_keys``, which identifies
    the set of keys with their shapes: sums of the 32-bit lanes of a 256-bit digest of each, so no list of keys is made."""
    keyed = F.col("key").isNotNull()
    entry = positions.withColumn("entry", F.when(keyed, _digest(F.col("key"), F.col("optional"), F.col("sig"))))
    return entry.groupBy(*SHAPE, F.col("parent").alias("path")).agg(
        F.count_if(keyed).alias("n_keys"), F.min(F.when(keyed, F.col("sig"))).alias("low"), F.max(F.when(keyed, F.col("sig"))).alias("high"),
        F.min_by(F.when(keyed, F.col("key")), F.when(keyed, F.col("first"))).alias("first_key"), F.concat_ws(",", *[F.sum(_lane(F.col("entry"), i)) for i in range(LANES)]).alias("all_keys"), F.max(F.when(~keyed, F.col("sig"))).alias("element"),
    )


def _positions(places: DataFrame) -> DataFrame:
    """A row for each place: how often it was seen, when first, with how many kinds of value, and whether its object can lack it.

    Of a query, a key can be lacking if another is there more often; of a body, if it is there less often than its object.
    """
    on = [*SHAPE, "path", "parent", "key", "depth"]
    seen = places.groupBy(*on).agg(F.sum("samples").alias("seen"), F.min("first").alias("first"), F.count(F.lit(1)).alias("kinds"))
    objects = places.where("family = 'object'").select(*SHAPE, F.col("path").alias("parent"), F.col("samples").alias("of"))
    query = (F.col("slot") == "query") & (F.col("depth") == 1)
    joined = seen.join(objects, [*SHAPE, "parent"], "left")
    if places.where(query).isEmpty():  # else all places of a shape would meet in one task for nothing
        joined = joined.withColumn("most", F.lit(None).cast("long"))
    else:
        joined = joined.join(seen.where(query).groupBy("endpoint", "slot", "status").agg(F.max("seen").alias("most")), SHAPE, "left")
    return joined.withColumn("optional", F.when(F.col("key").isNotNull(), F.when(query, F.col("seen") < F.col("most")).otherwise(F.col("seen") < F.col("of")))).drop("of", "most")


def _placed(places: DataFrame) -> DataFrame:
    """``places`` with what ``_positions`` has of them, when the place was first seen as ``place_first``."""
    return places.join(_positions(places).select(*SHAPE, "path", "seen", "kinds", "optional", F.col("first").alias("place_first")), [*SHAPE, "path"])


def _none(places: DataFrame) -> DataFrame:
    return places.select(*SHAPE, "path", F.lit(0).cast("long").alias("n_keys"), "key").withColumnRenamed("key", "first_key").where("false")


def _has_big(places: DataFrame, least: int) -> bool:
    """Whether an object has ``least`` keys."""
    keys = places.where("key is not null").select(*SHAPE, "parent", "key").distinct().groupBy(*SHAPE, "parent").agg(F.count(F.lit(1)).alias("n_keys"))
    return not keys.where(F.col("n_keys") >= least).isEmpty()


def dictionaries(places: DataFrame, least: int = shapes.RECORD_KEYS) -> DataFrame:
    """(endpoint, slot, status, path, n_keys, first_key) of objects with at least ``least`` keys, all of one shape."""
    return _dictionaries(kept(_placed(places)), least) if _has_big(places, least) else _none(places)


def _dictionaries(placed: DataFrame, least: int) -> DataFrame:
    """``dictionaries`` of what ``_placed`` gives.

    From the deepest places to the root, each place gets a signature of 256 bits from those below it, as in a Merkle tree; every step
    is one aggregate, so an object's keys are never listed, however many there are.  Signatures of a place's kinds of value
    are brought together only where it has several.
    """
    deepest = placed.agg(F.max("depth")).first()[0]
    place = [*SHAPE, "path", "parent", "key", "optional", "place_first"]
    kids, found = None, _none(placed)
    for depth in range(deepest, -1, -1):
        here = placed.where(F.col("depth") == depth)
        if kids is None:
            here = here.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("n_keys", "long"), ("low", "string"), ("high", "string"), ("first_key", "string"), ("all_keys", "string"), ("element", "string"))])
        else:
            here = here.join(kids, [*SHAPE, "path"], "left")
        root_query = (F.col("slot") == "query") & (F.col("path") == "")
        is_record = (F.col("family") == "object") & (F.col("n_keys") >= least) & (F.col("low") == F.col("high")) & ~root_query
        sig = F.when(is_record, _digest("record", F.col("low"))).when(F.col("family") == "object", _digest("object", F.coalesce("n_keys", F.lit(0)), F.col("all_keys")))
        sig = sig.when(F.col("family") == "array", _digest("array", F.col("element"))).otherwise(_digest(F.col("family"), F.coalesce("all_int", F.lit(True)), F.coalesce("fmt_mask", F.lit(0))))
        here = kept(here.select(*place, "kinds", sig.alias("sig"), is_record.alias("is_record"), "n_keys", "first_key"))
        found = found.union(here.where("is_record").select(*SHAPE, "path", "n_keys", "first_key"))
        if depth:
            one = here.where("kinds = 1").select(*place, _digest(F.col("sig")).alias("sig"))
            several = here.where("kinds > 1").groupBy(*place).agg(_digest(F.array_join(F.sort_array(F.collect_list("sig")), ",")).alias("sig"))
            kids = kept(_kids(one.union(several).withColumnRenamed("place_first", "first")))
    return kept(found)


#: So many levels of dictionaries are looked up in one plan.
LEVELS = 8


def _renamed(places: DataFrame, found: DataFrame) -> DataFrame:
    """(endpoint, slot, status, path, new, main): where each place below a dictionary goes; ``main`` are those by its first key.

    Each level of dictionaries is looked up by one join, so what is above a place is never listed.
    """
    steps = F.split("path", SEP)
    levels = found.select(*SHAPE, F.col("path").alias("up"), "first_key", F.size(steps).alias("at"))
    by = places.select(*SHAPE, "path").distinct().withColumn("hits", F.array().cast("array<struct<at:int,first_key:string>>"))
    for n, (at,) in enumerate(levels.select("at").distinct().orderBy("at").collect()):
        level = levels.where(F.col("at") == at).drop("at").withColumn("is_hit", F.lit(True))
        up = F.when(F.size(steps) > at, F.array_join(F.slice(steps, F.lit(1), F.lit(at)), SEP))
        hits = F.when(F.col("is_hit"), F.array_append("hits", F.struct(F.lit(at).alias("at"), "first_key"))).otherwise(F.col("hits"))
        by = by.withColumn("up", up).join(level, [*SHAPE, "up"], "left").select(*SHAPE, "path", hits.alias("hits"))
        if n % LEVELS == LEVELS - 1:
            by = kept(by)
    by = by.where(F.size("hits") > 0).select(*SHAPE, "path", F.map_from_entries("hits").alias("keys"))
    new = F.array_join(F.transform(steps, lambda x, i: F.when(F.map_contains_key("keys", i), "{}").otherwise(x)), SEP)
    main = F.forall(F.transform(steps, lambda x, i: ~F.map_contains_key("keys", i) | (x == F.concat(F.lit("."), F.try_element_at("keys", i)))), lambda x: x)
    return by.select(*SHAPE, "path", new.alias("new"), main.alias("main"))


def _parent(path: Column) -> Column:
    steps = F.split(path, SEP)
    return F.when(path != "", F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), SEP))


def observed(parts: DataFrame, options: Options = Options()) -> DataFrame:
    """``VARIANTS`` of what ``shapes.observe`` saw: dictionaries first, vocabularies afterwards."""
    places = kept(shapes.places(parts))
    big = _has_big(places, options.record_keys)
    whole = kept(_placed(places)) if big else _placed(places)
    found = _dictionaries(whole, options.record_keys) if big else None
    values = parts
    if found is not None and not found.isEmpty():
        moved = kept(_renamed(places, found))
        on = [*SHAPE, "path"]
        whole = whole.join(found.select(*on, F.lit(True).alias("is_record")), on, "left").join(moved, on, "left").where(F.coalesce("main", F.lit(True)))
        whole = whole.withColumn("family", F.when(F.col("is_record") & (F.col("family") == "object"), "record").otherwise(F.col("family")))
        whole = whole.withColumn("path", F.coalesce("new", "path")).withColumn("parent", _parent(F.col("path"))).withColumn("key", F.when(~F.endswith("path", F.lit("{}")), F.col("key")))
        whole = whole.drop("new", "main", "is_record")
        values = parts.where("family = 'string'").join(moved, on, "left").withColumn("path", F.coalesce("new", "path"))
    whole = kept(whole)
    listed = shapes.vocabularies(values, whole, options.enum_max, options.enum_min).select(*SHAPE, "path", F.col("values").alias("enum"))
    joined = whole.join(listed, [*SHAPE, "path"], "left")
    in_query = (F.col("slot") == "query") & (F.col("depth") <= 1)
    keyed = F.when(F.col("key").isNotNull() & ~in_query, F.col("seen"))
    kind = F.when(F.col("family").isin("num", "string", "boolean"), "primitive").otherwise(F.col("family"))
    type_ = F.when(F.col("family") == "num", F.when(F.col("all_int"), "integer").otherwise("number")).when(F.col("family").isin("string", "boolean"), F.col("family"))
    listed_formats = F.filter(F.array(*[F.when(F.col("fmt_mask").bitwiseAND(F.lit(bit)) != 0, name) for name, bit in formats.BIT.items()]), lambda x: x.isNotNull())
    by_place = Window.partitionBy(*SHAPE, "path").orderBy(F.col("kind") == "null", "first")
    by_key = Window.partitionBy(*SHAPE, "parent").orderBy("place_first", "path")
    d = joined.select(
        *SHAPE, "path", "parent", "key", kind.alias("kind"), type_.alias("type"), F.when(F.size(listed_formats) > 0, listed_formats).alias("formats"), "enum",
        F.when((F.col("family") == "object") & ~in_query, F.col("samples")).alias("samples"), keyed.alias("seen"), F.coalesce("optional", F.lit(False)).alias("optional"), "first", "place_first",
    )
    d = d.withColumn("variant", F.row_number().over(by_place) - 1).withColumn("place", F.dense_rank().over(by_key) - 1).withColumn("copy", F.lit(0))
    return kept(d.select(*[c.split()[0] for c in VARIANTS.split(", ")]))


def texts(variants: DataFrame) -> DataFrame:
    """``TEXTS``: the type text of every variant, of its place without null (``core_text``), and of the whole place.

    The variants of one shape, whose number is that of its distinct places, meet in a task.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, *found) for found in trees.texts(trees.build(trees.rows_of(pdf)))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TEXTS.split(", ")])

    return variants.groupBy(*SHAPE).applyInPandas(run, TEXTS)


def build(exchanges: DataFrame, name: str = "recording", target: str = "", options: Options = Options(), generated_at: int = 0, shaped: bool = True) -> Model:
    """The model of ``exchanges`` (method, pattern, endpoint, params, status, ord, body, content_type; req_body and url where there are)."""
    return of_state(state.gathered(exchanges), name, target, options, generated_at, shaped)


def of_state(s: state.State, name: str = "recording", target: str = "", options: Options = Options(), generated_at: int = 0, shaped: bool = True) -> Model:
    """The model that a state holds: of one batch, of merged ones, or of a stream so far; without ``shaped`` bodies aren't looked at."""
    ends = s.endpoints.select("endpoint", "method", "pattern", F.col("n").alias("samples"), "request_sample")
    ends = ends.withColumn("operation_id", S.operation_name(F.col("method"), F.col("pattern"))).withColumn("type_name", S.type_name(F.col("method"), F.col("pattern")))
    listed = s.samples.groupBy("endpoint", "index").agg(F.transform(F.sort_array(F.collect_list(F.struct("first_ord", "value"))), lambda v: v["value"]).alias("samples"))
    types = s.types.groupBy("endpoint", "status").agg(F.max_by("content_type", F.struct("n", -F.col("first_ord"))).alias("content_type"))
    responses = s.responses.select("endpoint", "status", F.col("n").alias("count"), "sample_body").join(types, ["endpoint", "status"], "left")
    params = s.params.drop("first_ord").join(listed, ["endpoint", "index"])
    variants = lambda: observed(kept(s.parts), options) if shaped else _no_shapes(ends.sparkSession)
    made = together(lambda: kept(ends), lambda: kept(params), lambda: kept(responses), variants)
    return Model(name, target, *made, generated_at)


def _no_shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VARIANTS)


def exchange_ids(exchanges: DataFrame, column: str = "id") -> DataFrame:
    """(endpoint, ord, id) in order of arrival; a row for each exchange, so a hot endpoint is no list."""
    return exchanges.select("endpoint", "ord", column).orderBy("endpoint", "ord")


def from_rows(spark: SparkSession, name: str, target: str, ends: Iterable[tuple], responses: Iterable[tuple], variants: Iterable[tuple], params: Iterable[tuple] = (), generated_at: int = 0) -> Model:
    """A model of given rows: a claim's, or a model file's."""
    e = spark.createDataFrame(list(ends), "endpoint string, method string, pattern string, samples long, request_sample string, operation_id string, type_name string")
    p = spark.createDataFrame(list(params), "endpoint string, index int, name string, format string, samples array<string>")
    r = spark.createDataFrame(list(responses), "endpoint string, status int, count long, sample_body string, content_type string")
    return Model(name, target, e, p, r, spark.createDataFrame(list(variants), VARIANTS), generated_at)
