"""The drift report: two models compared place by place, a being believed and b observed.

Everything is a join of the two sides' variants and positions (places of a shape).  A place that both sides have under
one path is compared, since all that is above it then agrees in kind; a place that one side has alone is a
finding where both sides have the object or array it belongs to.  Union variants meet by kind, type and number
of their kind, so each side's second object meets the other's second.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import kept, together
from .model import Model, texts
from .shapes import SEP, SHAPE

RANK = {"breaking": 0, "risky": 1, "info": 2}
LOW_CONFIDENCE = 3
#: Groups of rules; ``shapes`` are those of bodies and queries.
RULES = ("endpoints", "statuses", "params", "shapes")
COLUMNS = ["severity", "kind", "endpoint", "status", "path", "before", "after", "message", "b_samples", "seq"]
_ON = [*SHAPE, "path"]
_NOTES = ["kind", "type", "formats", "enum", "copy", "text"]


def _finding(rows: DataFrame, severity, kind, message: Column, before: Column | None = None, after: Column | None = None, samples: Column | None = None, step: Column | int = 0, path: Column | None = None) -> DataFrame:
    """Findings from rows that have endpoint and, of shapes, slot, status and path; ``step`` orders what a place has several of."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    has = lambda c: c in rows.columns
    slot = F.col("slot") if has("slot") else F.lit("response")
    status = F.col("status") if has("status") else F.lit(-1)
    rank = F.when(slot == "response", 0).when(slot == "request", 1).when(slot == "query", 2).otherwise(3)
    seq = F.concat_ws("/", rank, F.lpad(status.cast("string"), 6, " "), F.lpad(lit(step).cast("string"), 6, " "))
    place = path if path is not None else _shown(slot, F.col("path")) if has("path") else none
    return rows.select(
        lit(severity).alias("severity"), lit(kind).alias("kind"), "endpoint", F.when(status >= 0, status).cast("int").alias("status"), place.alias("path"),
        (none if before is None else before.cast("string")).alias("before"), (none if after is None else after.cast("string")).alias("after"), message.alias("message"),
        (F.lit(None) if samples is None else samples).cast("long").alias("b_samples"), seq.alias("seq"),
    )


def _shown(slot: Column, path: Column) -> Column:
    """A place as a report names it: a response's root has no name, another's is its slot."""
    plain = F.replace(F.regexp_replace(path, SEP + r"\|[0-9]+", ""), F.lit(SEP), F.lit(""))
    return F.when(slot == "response", F.nullif(F.regexp_replace(plain, r"^\.", ""), F.lit(""))).otherwise(F.concat(slot, plain))


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, SEP), -1)


def _side(model: Model, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants with their texts, positions) of the endpoints that both sides have."""
    mine = model.variants.join(shared, "endpoint", "left_semi")
    joined = kept(mine.join(texts(mine), [*_ON, "variant"]))
    core = F.col("kind") != "null"
    positions = joined.groupBy(*_ON, "parent", "key").agg(
        F.bool_or("optional").alias("optional"), F.max("seen").alias("seen"), F.bool_or(~core).alias("nullable"), F.count_if(core).alias("n"), F.max(F.when(core, F.col("kind"))).alias("one"),
        F.max(F.when(core, F.col("type"))).alias("type"), F.first("core_text").alias("core_text"), F.first("whole_text").alias("whole_text"),
    )
    return joined, kept(positions)


def _base(path: Column, copy: Column) -> Column:
    return F.when(copy > 0, F.concat(path, F.lit(f"{SEP}|"), copy.cast("string"))).otherwise(path)


def _endpoints(a: Model, b: Model) -> DataFrame:
    gone = a.endpoints.select("endpoint").distinct().join(b.endpoints, "endpoint", "left_anti")
    new = b.endpoints.select("endpoint").distinct().join(a.endpoints, "endpoint", "left_anti")
    return _finding(gone, "breaking", "endpoint-removed", F.format_string("Endpoint %s was removed (present in a, absent in b).", "endpoint")).union(
        _finding(new, "info", "endpoint-added", F.format_string("Endpoint %s was added (absent in a, present in b).", "endpoint"))
    )


def _statuses(a: Model, b: Model, shared: DataFrame) -> DataFrame:
    on = ["endpoint", "status"]
    gone = a.responses.select(*on).join(b.responses, on, "left_anti").join(shared, "endpoint", "left_semi")
    new = b.responses.select(*on).join(a.responses, on, "left_anti").join(shared, "endpoint", "left_semi")
    return _finding(gone, "risky", "status-removed", F.format_string("Response status %d was removed (present in a, absent in b).", "status")).union(
        _finding(new, "risky", "status-added", F.format_string("Response status %d was added (absent in a, present in b).", "status"))
    )


def _params(a: Model, b: Model) -> DataFrame:
    x, y = (m.params.select("endpoint", F.col("name"), F.col("format").alias(f)) for m, f in ((a, "fa"), (b, "fb")))
    rows = x.join(y, ["endpoint", "name"]).where("fa <> fb").withColumn("slot", F.lit("params"))
    message = F.format_string('Path param "%s" format changed from %s to %s.', "name", "fa", "fb")
    return _finding(rows, "risky", "params-changed", message, F.col("fa"), F.col("fb"), path=F.col("name"))


def _alone(pos: DataFrame, objects: DataFrame, arrays: DataFrame, roots: DataFrame, evidence: Column) -> DataFrame:
    """Findings of places that one side has alone."""
    lone = pos.where("a_here is null or b_here is null").withColumn("gone", F.col("b_here").isNull())
    before, after = F.when(F.col("gone"), F.col("whole_text_a")).otherwise("none"), F.when(F.col("gone"), F.lit("none")).otherwise(F.col("whole_text_b"))
    body = F.when(F.col("gone"), "Body was removed in b (present in a).").otherwise("Body appeared in b (absent in a).")
    root = lone.where("path = ''")
    response = root.where("slot = 'response'").join(roots.select("endpoint", "status", F.lit(True).alias("both")), ["endpoint", "status"], "left_semi")
    element = lone.where(F.endswith("path", F.lit(SEP + "[]"))).join(arrays, [*SHAPE, "parent"], "left_semi")
    keyed = lone.where("key is not null").join(objects, [*SHAPE, "parent"])
    request, query = root.where("slot = 'request'"), root.where("slot = 'query'")
    say = lambda gone, new: F.when(F.col("gone"), gone).otherwise(new)
    return (
        _finding(response.unionByName(element), "breaking", "type-changed", body, before, after, evidence, 20)
        .union(_finding(request, say("info", "breaking"), "request-changed", say('Request body was removed in b (present in a) (path prefix "request").', 'Request body is now required in b but was absent in a (path prefix "request").'), before, after))
        .union(_finding(query, say("info", "risky"), "query-changed", say('Query shape was removed in b (present in a) (path prefix "query").', 'Query shape appeared in b (absent in a) (path prefix "query").'), before, after))
        .union(_finding(keyed.where("gone"), "breaking", "field-removed", F.format_string('Field "%s" was removed in b.', "key"), F.col("whole_text_a"), None, F.coalesce("b_object", evidence)))
        .union(_finding(keyed.where("not gone"), "info", "field-added", F.format_string('Field "%s" was added in b.', "key"), None, F.col("whole_text_b"), F.coalesce("seen_b", "b_object", evidence)))
    )


def _compared(pos: DataFrame, objects: DataFrame, evidence: Column) -> DataFrame:
    """Findings of places that both sides have, but for their variants."""
    both = pos.where("a_here and b_here")
    text = (F.col("whole_text_a"), F.col("whole_text_b"))
    keyed = both.where("key is not null and optional_a <> optional_b").join(objects, [*SHAPE, "parent"])
    became = F.when(F.col("optional_b"), "optional in b (was required)").otherwise("required in b (was optional)")
    out = _finding(keyed, F.when(F.col("optional_b"), "risky").otherwise("info"), "optionality-changed", F.format_string('Field "%s" became %s.', "key", became), *text, F.coalesce("b_object", evidence))
    nulls = F.when(F.col("nullable_b"), "Became nullable in b (a did not allow null).").otherwise("Became non-nullable in b (a allowed null).")
    out = out.union(_finding(both.where("nullable_a <> nullable_b"), F.when(F.col("nullable_b"), "breaking").otherwise("info"), "nullability-changed", nulls, *text, evidence, 10))
    core = both.where("n_a > 0 and n_b > 0")
    text = (F.col("core_text_a"), F.col("core_text_b"))
    unknown_a, unknown_b = (F.col(f"one_{s}") == "unknown" for s in "ab")
    refined = core.where(unknown_a & ~unknown_b)
    lost = core.where(~unknown_a & unknown_b)
    out = out.union(_finding(refined, "info", "type-changed", F.lit("Type refined in b (a was unknown)."), *text, evidence, 20))
    out = out.union(_finding(lost, "risky", "type-changed", F.lit("Type became unknown in b (a was concrete)."), *text, evidence, 20))
    single = core.where(~unknown_a & ~unknown_b & F.expr("n_a = 1 and n_b = 1"))
    kinds = F.format_string("Kind changed from %s to %s.", "one_a", "one_b")
    out = out.union(_finding(single.where("one_a <> one_b"), "breaking", "type-changed", kinds, *text, evidence, 20))
    types = single.where("one_a = 'primitive' and one_b = 'primitive' and type_a <> type_b")
    severity = F.when(F.col("type_a").isin("integer", "number") & F.col("type_b").isin("integer", "number"), "info").otherwise("breaking")
    return out.union(_finding(types, severity, "type-changed", F.format_string("Primitive type changed from %s to %s.", "type_a", "type_b"), *text, evidence, 20))


def _variants(pos: DataFrame, va: DataFrame, vb: DataFrame, evidence: Column) -> DataFrame:
    """Findings of variants: unmatched ones of unions, and enums and formats of primitives that meet."""
    core = pos.where("a_here and b_here and n_a > 0 and n_b > 0 and one_a <> 'unknown' and one_b <> 'unknown'")
    wide = core.where("n_a > 1 or n_b > 1").select(*_ON, "core_text_a", "core_text_b", evidence.alias("ev"))
    side = lambda v, s: v.where("kind <> 'null'").select(*_ON, "variant", *[F.col(c).alias(f"{c}_{s}") for c in _NOTES]).withColumnRenamed("variant", f"variant_{s}")
    x, y = side(va, "a").join(wide, _ON), side(vb, "b").join(wide.drop("core_text_a", "core_text_b", "ev"), _ON)
    slot = lambda s: F.concat_ws("|", F.col(f"kind_{s}"), F.coalesce(F.col(f"type_{s}"), F.lit("")), F.col(f"copy_{s}"))
    x, y = x.withColumn("meet", slot("a")), y.withColumn("meet", slot("b"))
    label = lambda s: F.coalesce(F.col(f"type_{s}"), F.col(f"kind_{s}"))
    gone = x.join(y.select(*_ON, "meet"), [*_ON, "meet"], "left_anti")
    new = y.join(x.select(*_ON, "meet"), [*_ON, "meet"], "left_anti").join(wide, _ON)
    out = _finding(gone, "info", "type-changed", F.format_string('Variant "%s" from a is absent in b (type narrowed).', label("a")), F.col("text_a"), F.col("core_text_b"), F.col("ev"), F.col("variant_a") + 20)
    out = out.union(_finding(new, "risky", "type-changed", F.format_string('Variant "%s" appeared in b (type widened).', label("b")), F.col("core_text_a"), F.col("text_b"), F.col("ev"), F.col("variant_b") + 40))
    primitive = F.expr("kind_a = 'primitive' and kind_b = 'primitive'")
    narrow = core.where("n_a = 1 and n_b = 1").select(*_ON, evidence.alias("ev"))
    alone = side(va, "a").join(narrow, _ON).join(side(vb, "b"), _ON)
    met = x.join(y, [*_ON, "meet"])
    names = [*_ON, *[f"{c}_{s}" for s in "ab" for c in ("variant", *_NOTES)], "ev"]
    pairs = kept(alone.select(*names).union(met.select(*names)).where(primitive))
    text = (F.col("text_a"), F.col("text_b"))
    listed = lambda p, q: F.filter(p, lambda v: ~F.array_contains(q, v))
    enums = pairs.where("enum_a is not null and enum_b is not null").withColumn("more", listed("enum_b", F.col("enum_a"))).withColumn("less", listed("enum_a", F.col("enum_b")))
    say = lambda words, c: F.concat(F.lit(words), F.array_join(c, ", "), F.lit("."))
    step = F.col("variant_a") + 60
    out = out.union(_finding(enums.where(F.size("more") > 0), "risky", "enum-values-changed", say("Enum values added in b: ", "more"), *text, F.col("ev"), step))
    out = out.union(_finding(enums.where(F.size("less") > 0), "info", "enum-values-changed", say("Enum values removed in b: ", "less"), *text, F.col("ev"), step))
    opened = pairs.where("enum_a is not null and enum_b is null")
    out = out.union(_finding(opened, "risky", "enum-values-changed", F.lit("Enum in a became an open primitive in b (closed set opened)."), *text, F.col("ev"), step))
    fmt = lambda c: F.sort_array(F.coalesce(c, F.array().cast("array<string>")))
    formats = pairs.withColumn("fa", fmt("formats_a")).withColumn("fb", fmt("formats_b")).withColumn("lost", F.array_except("fa", "fb")).withColumn("won", F.array_except("fb", "fa"))
    shown = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    out = out.union(_finding(formats.where(F.size("lost") > 0), "risky", "format-changed", F.format_string("Format lost or changed in b (was %s, now %s).", shown("fa"), shown("fb")), *text, F.col("ev"), step + 1))
    return out.union(_finding(formats.where((F.size("lost") == 0) & (F.size("won") > 0)), "info", "format-changed", F.format_string("Format gained in b (now %s).", F.array_join("fb", ", ")), *text, F.col("ev"), step + 1))


def findings(a: Model, b: Model, ignore_unmatched: bool = False, rules: Sequence[str] = RULES) -> DataFrame:
    """All findings (``COLUMNS``) of the given groups of rules, not yet in order."""
    shared = kept(a.endpoints.select("endpoint").distinct().join(b.endpoints.select("endpoint").distinct(), "endpoint"))
    parts = []
    if "endpoints" in rules and not ignore_unmatched:
        parts.append(_endpoints(a, b))
    if "statuses" in rules:
        parts.append(_statuses(a, b, shared))
    if "params" in rules:
        parts.append(_params(a, b))
    if "shapes" in rules:
        parts += _shapes(a, b, shared)
    return kept(reduce(DataFrame.union, parts))


def _shapes(a: Model, b: Model, shared: DataFrame) -> list[DataFrame]:
    (va, pa), (vb, pb) = together(lambda: _side(a, shared), lambda: _side(b, shared))
    roots = a.responses.select("endpoint", "status").join(b.responses.select("endpoint", "status", "count"), ["endpoint", "status"])
    named = lambda p, s: p.select(*_ON, "parent", "key", F.lit(True).alias(f"{s}_here"), *[F.col(c).alias(f"{c}_{s}") for c in ("optional", "seen", "nullable", "n", "one", "type", "core_text", "whole_text")])
    left, right = named(pa, "a"), named(pb, "b").withColumnsRenamed({"parent": "parent_r", "key": "key_r"})
    pos = left.join(right, _ON, "full_outer").withColumn("parent", F.coalesce("parent", "parent_r")).withColumn("key", F.coalesce("key", "key_r")).drop("parent_r", "key_r")
    # the evidence at a place: the presence of the nearest field of b above it, or the response's count
    anchor = F.regexp_replace("path", f"({SEP}(\\[\\]|\\{{\\}}|\\|[0-9]+))+$", "")
    seen = pb.select(*SHAPE, F.col("path").alias("anchor"), F.col("seen").alias("anchor_seen"))
    pos = pos.withColumn("anchor", anchor).join(seen, [*SHAPE, "anchor"], "left").join(b.responses.select("endpoint", "status", F.col("count").alias("root_count")), ["endpoint", "status"], "left")
    pos = kept(pos)
    evidence = F.coalesce("anchor_seen", "root_count")
    object_of = lambda v: v.where("kind = 'object'").select(*SHAPE, _base(F.col("path"), F.col("copy")).alias("parent"), F.col("samples").alias("b_object"))
    array_of = lambda v: v.where("kind = 'array'").select(*SHAPE, _base(F.col("path"), F.col("copy")).alias("parent"))
    objects = kept(object_of(vb).join(object_of(va).drop("b_object"), [*SHAPE, "parent"]))
    arrays = array_of(va).join(array_of(vb), [*SHAPE, "parent"])
    return [_alone(pos, objects, arrays, roots, evidence), _compared(pos, objects, evidence), _variants(pos, va, vb, evidence)]


def in_order(found: DataFrame) -> DataFrame:
    """Findings by severity, endpoint, path (none first) and kind; equal ones in the order they are met in a model."""
    rank = F.when(F.col("severity") == "breaking", 0).when(F.col("severity") == "risky", 1).otherwise(2)
    return found.orderBy(rank, "endpoint", F.col("path").asc_nulls_first(), "kind", "seq")


def summary(a: Model, b: Model, found: DataFrame) -> DataFrame:
    """One row of counters; endpoints of one side count even where their findings are left out."""
    x, y = (m.endpoints.select("endpoint").distinct().withColumn(s, F.lit(True)) for m, s in ((a, "a"), (b, "b")))
    ends = x.join(y, "endpoint", "full_outer").agg(F.count_if(F.expr("a and b")).alias("endpoints_compared"), F.count_if(F.expr("b is null")).alias("endpoints_only_in_a"), F.count_if(F.expr("a is null")).alias("endpoints_only_in_b"))
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in RANK]).join(ends)


def at_least(found: DataFrame, level: str) -> bool:
    """Whether there is a finding of this severity or a worse one; stops at the first."""
    if level not in RANK:
        raise ValueError(f'Invalid level "{level}". Valid levels: {", ".join(RANK)}.')
    return not found.where(F.col("severity").isin([s for s, r in RANK.items() if r <= RANK[level]])).limit(1).isEmpty()


def low_confidence(samples: Column) -> Column:
    return F.coalesce(samples < LOW_CONFIDENCE, F.lit(False))
