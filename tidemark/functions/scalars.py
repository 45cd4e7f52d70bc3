"""Scalar functions of capture, path normalization and format detection as Column expressions.

``\\z`` anchors are used because ``$`` also matches before a final line feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import formats

#: Headers hidden by default, and those that concern one connection only.
REDACTED = ("authorization", "cookie", "set-cookie", "x-api-key")
HOP_BY_HOP = ("connection", "keep-alive", "transfer-encoding", "upgrade", "proxy-authenticate", "proxy-authorization", "te", "trailer")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_match(column: Column, pattern: str) -> Column:
    return F.rlike(column, F.lit(pattern))


def path_only(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*", 0)


def query_text(url: Column) -> Column:
    """What follows the first question mark; a fragment stays."""
    at = F.instr(url, "?")
    return F.when(at > 0, F.substring(url, at + 1, F.length(url))).otherwise(F.lit(""))


def parse_query(url: Column) -> Column:
    """Array of (key, value), in order; ``+`` is a blank, and broken escapes stay as they are."""

    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))

    pieces = F.filter(F.split(query_text(url), "&"), lambda x: x != "")
    return F.transform(pieces, lambda p: F.struct(decoded(F.regexp_extract(p, r"^[^=]*", 0)).alias("key"), decoded(F.regexp_extract(p, r"^[^=]*=?(?s:(.*))", 1)).alias("value")))


def query_map(url: Column) -> Column:
    """Keys of a query in order, each with all its values."""

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]).alias("values")))

    return bound(parse_query(url), grouped)


def _json_string(text: Column) -> Column:
    """A string as JSON text."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def query_json(url: Column) -> Column:
    """A query as the JSON text of an object: a value by its kind, several values of a key as an array."""

    def value(v: Column) -> Column:
        kind = coerce_query(v)
        return F.when(kind.isin("integer", "number"), F.regexp_replace(v, r"^(-?)0+(?=[0-9])", "$1")).when(kind == "boolean", v).otherwise(_json_string(v))

    def entry(e: Column) -> Column:
        listed = F.array_join(F.transform(e["values"], value), ",")
        return F.concat(_json_string(e["key"]), F.lit(":"), F.when(F.size(e["values"]) > 1, F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed))

    return F.concat(F.lit("{"), F.array_join(F.transform(query_map(url), entry), ","), F.lit("}"))


def coerce_query(value: Column) -> Column:
    """Kind of a query value: integer, number, boolean or string."""
    whole = is_match(value, r"^-?[0-9]+\z")
    decimal = is_match(value, r"^-?[0-9]+\.[0-9]+\z")
    number = value.try_cast("double")
    return F.when(whole | (decimal & (number == F.floor(number))), "integer").when(decimal, "number").when(value.isin("true", "false"), "boolean").otherwise("string")


def classify_segment(segment: Column, force: tuple[str, ...] = ()) -> Column:
    kind = F.when(is_match(segment, r"^[0-9]+\z"), "integer").when(is_match(segment, formats.whole(formats.UUID)), "uuid")
    kind = kind.when((F.length(segment) >= 16) & is_match(segment, r"^[A-Za-z0-9_-]+\z"), "string").otherwise("literal")
    return F.when(segment.isin(*force), "string").otherwise(kind) if force else kind


def singularize(word: Column) -> Column:
    n = F.length(word)
    return F.when(word.endswith("ies") & (n > 3), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y"))).when(word.endswith("s") & (n > 1), F.substring(word, F.lit(1), n - 1)).otherwise(word)


def sanitize_name(segment: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(segment, "[^a-zA-Z0-9]", ""), F.lit("")), F.lit("param"))


def _items(path: Column, force: tuple[str, ...]) -> Column:
    """The segments with their kinds and, of parameters, the name each would like to have."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.struct(s.alias("text"), classify_segment(s, force).alias("kind")))


def _wanted(items: Column) -> Column:
    def base(item: Column, i: Column) -> Column:
        before = F.get(items, i - 1)
        owner = (i > 0) & (before["kind"] == "literal") & is_match(before["text"], "^[a-zA-Z]")
        earlier = F.size(F.filter(F.slice(items, F.lit(1), i), lambda x: x["kind"] != "literal"))
        name = F.when(owner, F.concat(singularize(sanitize_name(before["text"])), F.lit("Id"))).otherwise(F.concat(F.lit("param"), earlier.cast("string")))
        return F.struct(i.alias("index"), item["text"].alias("value"), item["kind"].alias("format"), F.when(item["kind"] != "literal", name).alias("name"))

    return F.transform(items, base)


_SEGMENTS = "array<struct<index:int,value:string,format:string,name:string>>"


def path_segments(path: Column, force: tuple[str, ...] = ()) -> Column:
    """Segments of a concrete path (index, value, format, and the parameter's name, null of a literal).

    Names that are wanted twice get a number; only a path with such names goes through a fold.
    """
    return bound(bound(_items(path, force), _wanted), _unique)


def _unique(wanted: Column) -> Column:
    names = F.filter(F.transform(wanted, lambda w: w["name"]), lambda n: n.isNotNull())

    def step(done: Column, w: Column) -> Column:
        used = F.transform(done, lambda p: p["name"])
        options = F.concat(F.array(w["name"]), F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda k: F.concat(w["name"], k.cast("string"))))
        free = F.get(F.filter(options, lambda o: ~F.coalesce(F.array_contains(F.filter(used, lambda u: u.isNotNull()), o), F.lit(False))), F.lit(0))
        named = F.struct(w["index"].alias("index"), w["value"].alias("value"), w["format"].alias("format"), F.when(w["name"].isNotNull(), free).alias("name"))
        return F.concat(done, F.array(named)).cast(_SEGMENTS)

    folded = F.aggregate(wanted, F.array().cast(_SEGMENTS), step)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), wanted.cast(_SEGMENTS)).otherwise(folded)


def pattern_of(segments: Column) -> Column:
    """``/users/:userId`` from a path's segments."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s["name"].isNull(), s["value"]).otherwise(F.concat(F.lit(":"), s["name"]))), "/"))


def params_of(segments: Column) -> Column:
    """Parameters (name, index, format, value) from a path's segments."""
    found = F.filter(segments, lambda s: s["name"].isNotNull())
    return F.transform(found, lambda s: F.struct(s["name"].alias("name"), s["index"].alias("index"), s["format"].alias("format"), s["value"].alias("value")))


def normalize_path(path: Column, force: tuple[str, ...] = ()) -> Column:
    """(pattern, params) of a concrete path."""
    segments = path_segments(path, force)
    return F.struct(pattern_of(segments).alias("pattern"), params_of(segments).alias("params"))


def pascal(token: Column) -> Column:
    """Fragments between non-alphanumerics with their first character in upper case."""
    fragments = F.filter(F.split(token, "[^a-zA-Z0-9]+"), lambda f: f != "")
    return F.array_join(F.transform(fragments, lambda f: F.concat(F.upper(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f)))), "")


def operation_name(method: Column, pattern: Column) -> Column:
    words = F.transform(F.filter(F.split(pattern, "/"), lambda p: p != ""), lambda p: F.when(p.startswith(":"), F.concat(F.lit("By"), pascal(p))).otherwise(pascal(p)))
    return F.concat(F.lower(method), F.array_join(words, ""))


def type_name(method: Column, pattern: Column) -> Column:
    name = operation_name(method, pattern)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def openapi_path(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r":([A-Za-z0-9_]+)", r"{$1}")


def format_mask(value: Column) -> Column:
    """Bits of the string formats that a value has; a date-time isn't also a date."""
    one = lambda name, pattern: F.when(is_match(value, formats.whole(pattern)), formats.BIT[name]).otherwise(0)
    dates = F.when(is_match(value, formats.whole(formats.DATE_TIME)), formats.BIT["date-time"]).when(is_match(value, formats.whole(formats.DATE)), formats.BIT["date"]).otherwise(0)
    return one("uuid", formats.UUID) + dates + one("email", formats.EMAIL) + one("uri", formats.URI)


def is_numeric_data(value: Column) -> Column:
    """Strings that are the canonical writing of a number.

    The form is a plain decimal of at most 21 whole digits and five zeros after the point, or beyond that one digit with
    an exponent; and the digits are the shortest that tell the number from its neighbours, as a cast prints them.
    """
    plain = is_match(value, r"^-?(0|[1-9][0-9]{0,20})(\.[0-9]*[1-9])?\z") & (value != "-0") & ~is_match(value, r"^-?0\.0{6}")
    small, large = r"-([7-9]|[1-9][0-9]{1,2})", r"\+(2[1-9]|[3-9][0-9]|[1-3][0-9]{2})"
    power = is_match(value, rf"^-?[1-9](\.[0-9]*[1-9])?e({small}|{large})\z")

    def digits(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[-.]", ""), "^0+|0+$", "")

    number = value.try_cast("double")
    same = digits(value) == digits(number.cast("string"))
    return (plain | power) & F.coalesce(same & (F.abs(number) < float("inf")), F.lit(False))


def strip_hop_by_hop(headers: Column) -> Column:
    """Headers without those that concern one connection only."""
    return F.map_filter(headers, lambda k, v: v.isNotNull() & ~F.lower(k).isin(*HOP_BY_HOP) & ~F.startswith(F.lower(k), F.lit("proxy-")))


def is_json_type(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("json")), F.lit(False))


def should_record(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    wanted, barred = F.lit(not include), F.lit(False)
    for p in include:
        wanted |= path.startswith(p)
    for p in exclude:
        barred |= path.startswith(p)
    return wanted & ~barred


def normalize_headers(headers: Column, redact: tuple[str, ...] = REDACTED) -> Column:
    """Lower-case names (the last of equal ones counts), listed values hidden."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.when(F.lower(e["key"]).isin(*redact), "[redacted]").otherwise(e["value"]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def utf8_text(raw: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced by U+FFFD; no error for a character that is cut."""
    return F.when(F.is_valid_utf8(raw), raw.cast("string")).otherwise(F.make_valid_utf8(raw.cast("string")))


def decode_body(body: Column, cap: int, content_type: Column | None = None) -> Column:
    """(text, json) of a body, a string or bytes: none of an empty one; above ``cap`` bytes cut and never parsed; JSON
    that doesn't parse, or isn't of a JSON content type, is text only."""
    raw = body.cast("binary")
    long = F.octet_length(raw) > cap
    text = F.when(long, utf8_text(F.substring(raw, 1, cap))).otherwise(utf8_text(raw))
    able = ~long & F.try_parse_json(text).isNotNull()
    if content_type is not None:
        able = able & is_json_type(content_type)
    none = F.lit(None).cast("string")
    return F.when(F.octet_length(raw) > 0, F.struct(text.alias("text"), F.when(able, text).alias("json"))).otherwise(F.struct(none.alias("text"), none.alias("json")))


def escape_cell(text: Column) -> Column:
    """A table cell of Markdown."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), f"[{formats.WHITE}]+", " ")


def timestamp_text(ms: Column) -> Column:
    """Epoch milliseconds as ISO text; a dash for none."""
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.when(F.coalesce(ms, F.lit(0)) != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.lit("-"))


def response_suffix(status: Column, success: Column) -> Column:
    """Nothing for the response that stands for success, else its status."""
    return F.when(status == success, "").otherwise(status.cast("string"))


def register(spark: SparkSession) -> None:
    """The scalar functions for SQL, as SQL functions that Spark inlines into the query, and the table functions ``json_nodes`` and ``json_nodes_of``."""
    uuid = formats.UUID
    rule = lambda pattern: formats.whole(pattern).replace("\\", "\\\\").replace("'", "\\'")
    mask = " + ".join(
        [f"IF(value RLIKE '{rule(formats.UUID)}', 1, 0)", f"CASE WHEN value RLIKE '{rule(formats.DATE_TIME)}' THEN 2 WHEN value RLIKE '{rule(formats.DATE)}' THEN 4 ELSE 0 END"]
        + [f"IF(value RLIKE '{rule(p)}', {b}, 0)" for p, b in ((formats.EMAIL, 8), (formats.URI, 16))]
    )
    bodies = {
        "path_only(url STRING) RETURNS STRING": "regexp_extract(url, '^[^?#]*', 0)",
        "classify_segment(segment STRING) RETURNS STRING": f"CASE WHEN segment RLIKE '^[0-9]+\\\\z' THEN 'integer' WHEN segment RLIKE '{rule(uuid)}' THEN 'uuid' WHEN length(segment) >= 16 AND segment RLIKE '^[A-Za-z0-9_-]+\\\\z' THEN 'string' ELSE 'literal' END",
        "singularize(word STRING) RETURNS STRING": "CASE WHEN endswith(word, 'ies') AND length(word) > 3 THEN concat(left(word, length(word) - 3), 'y') WHEN endswith(word, 's') AND length(word) > 1 THEN left(word, length(word) - 1) ELSE word END",
        "sanitize_name(segment STRING) RETURNS STRING": "coalesce(nullif(regexp_replace(segment, '[^a-zA-Z0-9]', ''), ''), 'param')",
        "pascal_case(token STRING) RETURNS STRING": "array_join(transform(filter(split(token, '[^a-zA-Z0-9]+'), f -> f <> ''), f -> concat(upper(left(f, 1)), substr(f, 2))), '')",
        "operation_name(method STRING, pattern STRING) RETURNS STRING": "concat(lower(method), array_join(transform(filter(split(pattern, '/'), p -> p <> ''), p -> concat(IF(startswith(p, ':'), 'By', ''), array_join(transform(filter(split(p, '[^a-zA-Z0-9]+'), f -> f <> ''), f -> concat(upper(left(f, 1)), substr(f, 2))), ''))), ''))",
        "coerce_query(value STRING) RETURNS STRING": "CASE WHEN value RLIKE '^-?[0-9]+\\\\z' THEN 'integer' WHEN value RLIKE '^-?[0-9]+\\\\.[0-9]+\\\\z' THEN IF(try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)), 'integer', 'number') WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END",
        "format_mask(value STRING) RETURNS INT": mask,
        "openapi_path(pattern STRING) RETURNS STRING": "regexp_replace(pattern, ':([A-Za-z0-9_]+)', '{$1}')",
        "endpoint_key(method STRING, pattern STRING) RETURNS STRING": "concat_ws(' ', upper(method), pattern)",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("json_nodes", json_nodes())
    spark.udtf.register("json_nodes_of", json_nodes_of())


_NODE = "path string, parent string, key string, family string, is_int boolean, fmt_mask int, sval string, pos int"


def json_nodes():
    """A table function for lateral use: the nodes of a JSON text (path, parent, key, family, is_int, fmt_mask, sval, pos), sent and received in Arrow batches."""
    from pyspark.sql.functions import udtf

    class Nodes:
        def eval(self, body: str):
            from tidemark.operators.shapes import walk

            if body is not None:
                try:
                    yield from walk(body)
                except ValueError:
                    return

    return udtf(Nodes, returnType=_NODE, useArrow=True)


def json_nodes_of():
    """A table function of a whole table (its first column names the text, its second is the text): every text's nodes under its name.

    ``SELECT * FROM json_nodes_of(TABLE(SELECT id, body FROM t))``; Arrow batches go in and come out, without a call for each row.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf

    kinds = {"id": pa.string(), "path": pa.string(), "parent": pa.string(), "key": pa.string(), "family": pa.string(), "is_int": pa.bool_(), "fmt_mask": pa.int32(), "sval": pa.string(), "pos": pa.int32()}

    @arrow_udtf(returnType="id string, " + _NODE)
    class Nodes:
        def eval(self, batch: pa.RecordBatch):
            from tidemark.operators.shapes import walk

            rows: list[tuple] = []
            for name, body in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, *node) for node in walk(body)] if body is not None else []
                except ValueError:
                    continue
                if len(rows) >= 10_000:
                    yield self.table(rows)
                    rows = []
            if rows:
                yield self.table(rows)

        @staticmethod
        def table(rows):
            return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    return Nodes
