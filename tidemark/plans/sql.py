"""The same queries as DuckDB SQL, written independently over the raw tables."""

from __future__ import annotations

_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_SINGULAR = "CASE WHEN {x} LIKE '%ies' AND length({x}) > 3 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%s' AND length({x}) > 1 THEN left({x}, length({x}) - 1) ELSE {x} END"
_KIND = f"CASE WHEN regexp_full_match(seg, '[0-9]+') THEN 'integer' WHEN regexp_full_match(seg, '{_UUID}') THEN 'uuid' WHEN length(seg) >= 16 AND regexp_full_match(seg, '[A-Za-z0-9_-]+') THEN 'string' ELSE 'literal' END"

EXP = """exp AS (SELECT page_id AS ord, 'GET' AS method, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS url,
  regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '^[^?#]*', 0) AS path FROM pages)"""
EXE = """exe AS (SELECT event_id AS ord, CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS method,
  '/api/users/' || user_id || CASE event_type WHEN 'view' THEN '/views/' || event_id WHEN 'click' THEN '/clicks/' || event_id WHEN 'purchase' THEN '/orders/' || event_id ELSE '' END AS path,
  CASE WHEN event_type = 'signup' THEN 201 WHEN event_type <> 'error' THEN 200 WHEN user_id % 2 = 0 THEN 404 ELSE 500 END AS status,
  CASE WHEN event_id % 9 = 0 THEN 'application/problem+json' ELSE 'application/json' END AS content_type, user_id, ts,
  CASE event_type WHEN 'signup' THEN '{"name":"u' || user_id || '"' || CASE WHEN event_id % 3 = 0 THEN ',"plan":"pro"' ELSE '' END || '}' WHEN 'purchase' THEN '{"qty":' || (event_id % 5) || '}' END AS req_body,
  '/api/users/' || user_id || CASE event_type WHEN 'view' THEN '/views/' || event_id || '?page=' || (event_id % 9) || CASE WHEN event_id % 2 = 0 THEN '&sort=asc' ELSE '' END WHEN 'click' THEN '/clicks/' || event_id WHEN 'purchase' THEN '/orders/' || event_id ELSE '' END AS url,
  '{"id":' || event_id || ',"type":"' || event_type || '"' ||
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN ',"value":null' WHEN event_id % 11 = 0 THEN ',"value":"' || user_id || '"' ELSE ',"value":' || (event_id % 97) || CASE WHEN event_id % 3 = 0 THEN '.5' ELSE '' END END ||
  CASE event_id % 4 WHEN 0 THEN ',"tags":[]' WHEN 1 THEN ',"tags":["a"]' WHEN 2 THEN ',"tags":["a",1]' ELSE '' END ||
  CASE WHEN event_id % 2 = 0 THEN ',"at":"2024-01-05"' ELSE ',"at":"2024-01-05T10:00:00Z"' END || ',"mail":"u' || user_id || '@example.com","props":' || props || '}' AS body FROM events)"""


def norm(source: str) -> str:
    """``seg_x`` (segments with kinds and names) and ``norm_x`` (path to pattern) of a source's paths."""
    s = source
    clean = "CASE WHEN regexp_replace(prev, '[^a-zA-Z0-9]', '', 'g') = '' THEN 'param' ELSE regexp_replace(prev, '[^a-zA-Z0-9]', '', 'g') END"
    return f"""split_{s} AS (SELECT path, unnest(p) AS seg, generate_subscripts(p, 1) AS i FROM (SELECT path, string_split(path, '/')[2:] AS p FROM (SELECT DISTINCT path FROM {s}))),
kind_{s} AS (SELECT *, {_KIND} AS kind FROM split_{s}),
lag_{s} AS (SELECT *, lag(seg) OVER w AS prev, lag(kind) OVER w AS pkind, sum(CASE WHEN kind <> 'literal' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind <> 'literal' THEN 1 ELSE 0 END AS k FROM kind_{s} WINDOW w AS (PARTITION BY path ORDER BY i)),
base_{s} AS (SELECT * EXCLUDE (c), CASE WHEN kind = 'literal' THEN NULL WHEN pkind = 'literal' AND regexp_matches(prev, '^[a-zA-Z]') THEN {_SINGULAR.format(x="c")} || 'Id' ELSE 'param' || CAST(k AS BIGINT) END AS base FROM (SELECT *, {clean} AS c FROM lag_{s})),
seg_{s} AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY path, base ORDER BY i) > 1 THEN CAST(row_number() OVER (PARTITION BY path, base ORDER BY i) - 1 AS VARCHAR) ELSE '' END AS name FROM base_{s}),
norm_{s} AS (SELECT path, '/' || string_agg(CASE WHEN kind = 'literal' THEN seg ELSE ':' || name END, '/' ORDER BY i) AS pattern FROM seg_{s} GROUP BY path),
x_{s} AS (SELECT {s}.*, pattern, method || ' ' || pattern AS endpoint FROM {s} JOIN norm_{s} USING (path))"""


def tree(x: str, t: str) -> str:
    """Observations of the bodies of ``x`` under the names ``t``, ``{t}_nodes`` and ``{t}_fields``."""
    whole = "regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g')"
    return f"""{t} AS (SELECT endpoint, status, ord, {whole} AS path, regexp_replace(j.path, '\\[[0-9]+\\]', '[]', 'g') AS parent, CASE WHEN j.fullkey = '$' OR j.fullkey LIKE '%]' THEN NULL ELSE j.key END AS key,
  CASE WHEN j.type = 'NULL' THEN 'null' WHEN j.type IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN lower(j.type) WHEN j.type = 'VARCHAR' THEN 'string' ELSE 'num' END AS family,
  CASE WHEN j.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(j.atom AS DOUBLE) = floor(CAST(j.atom AS DOUBLE)) END AS is_int,
  CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS sval FROM {x}, json_tree({x}.body) AS j),
{t}_mask AS (SELECT *, CASE WHEN sval IS NULL THEN NULL ELSE CASE WHEN regexp_full_match(sval, '{_UUID}') THEN 1 ELSE 0 END + CASE WHEN regexp_full_match(sval, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})') THEN 2 WHEN regexp_full_match(sval, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 4 ELSE 0 END
  + CASE WHEN regexp_full_match(sval, '[^ @]+@[^ @]+[.][^ @]+') THEN 8 ELSE 0 END + CASE WHEN regexp_full_match(sval, '[a-zA-Z][a-zA-Z0-9+.-]*://[^ ]+') THEN 16 ELSE 0 END END AS mask FROM {t}),
{t}_nodes AS (SELECT endpoint, status, path, family, count(*) AS samples, bool_and(is_int) AS all_int, bit_and(mask) AS fmt_mask FROM {t}_mask GROUP BY ALL),
{t}_fields AS (SELECT f.*, n.samples, f.seen < n.samples AS optional FROM (SELECT endpoint, status, parent, key, count(*) AS seen FROM {t} WHERE key IS NOT NULL GROUP BY ALL) f JOIN {t}_nodes n ON n.endpoint = f.endpoint AND n.status = f.status AND n.path = f.parent AND n.family = 'object'),
{t}_enums AS (SELECT v.endpoint, v.status, v.path, sum(v.n) AS samples, list_sort(list(v.sval)) AS vals FROM (SELECT endpoint, status, path, sval, count(*) AS n, bit_and(mask) AS mask FROM {t}_mask WHERE family = 'string' GROUP BY ALL) v
  WHERE (v.endpoint, v.status, v.path) IN (SELECT (endpoint, status, path) FROM {t}_nodes GROUP BY endpoint, status, path HAVING count(*) = 1)
  GROUP BY ALL HAVING sum(v.n) >= 4 AND count(*) <= 8 AND count(*) <= ceil(sum(v.n) / 2) AND bit_and(v.mask) = 0 AND bool_and(regexp_full_match(v.sval, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,31}}') AND NOT regexp_full_match(v.sval, '-?(0|[1-9][0-9]{{0,14}})([.][0-9]{{0,5}}[1-9])?'))),
{t}_types AS (SELECT endpoint, status, path, bool_or(family = 'null') AS nullable, CASE WHEN count(*) FILTER (family <> 'null') > 1 THEN 'union' WHEN count(*) FILTER (family <> 'null') = 0 THEN 'null' ELSE max(CASE WHEN family = 'num' THEN CASE WHEN all_int THEN 'integer' ELSE 'number' END WHEN family <> 'null' THEN family END) END AS type, max(CASE WHEN family = 'string' THEN fmt_mask END) AS mask, sum(samples) AS samples FROM {t}_nodes GROUP BY ALL)"""


_BODY = """replace(replace(replace(replace(replace(body, ',"mail":"u', ',"email":"u'), '"type":"view"', '"type":"peek"'), '"at":"2024-01-05"', '"at":"2024-01-05T11:00:00Z"'), '{"id":' || ord || ',', '{"id":"' || ord || '",'), ',"value":"' || user_id || '"', ',"value":true')"""
SIDES = f"""a0 AS (SELECT * FROM exe WHERE ts < TIMESTAMP '2024-01-16'),
b0 AS (SELECT * REPLACE (CASE WHEN status = 500 THEN 503 ELSE status END AS status, CASE WHEN method = 'PUT' THEN 'PATCH' ELSE method END AS method,
  CASE WHEN status <> 404 THEN CASE WHEN ord % 6 = 0 THEN regexp_replace({_BODY}, ',"props":.*$', ',"props":null}}') ELSE {_BODY} END END AS body,
  CASE WHEN status >= 400 THEN '{{"x":1}}' WHEN method <> 'POST' THEN req_body END AS req_body,
  CASE WHEN contains(path, '/views/') THEN path WHEN contains(path, '/clicks/') THEN path || '?ref=x' ELSE url END AS url,
  replace(path, '/clicks/', '/clicks/click-0000000000000000') AS path) FROM exe WHERE ts >= TIMESTAMP '2024-01-16')"""
_E = EXE + ",\n" + norm("exe")
_T = "WITH " + _E + ",\n" + tree("x_exe", "t")
_D = "WITH " + EXE + ",\n" + SIDES + ",\n" + norm("a0") + ",\n" + norm("b0")
_DT = _D + ",\n" + tree("x_a0", "a") + ",\n" + tree("x_b0", "b")
_PATHS = "(SELECT a_types.*, b_types.nullable AS nb, b_types.type AS tb, b_types.mask AS mb, b_types.samples AS sb FROM a_types JOIN b_types USING (endpoint, status, path))"


def _finding(severity: str, kind: str, source: str, where: str, message: str, status: str = "NULL", path: str = "NULL", samples: str = "NULL") -> str:
    place = f"nullif(regexp_replace(CAST({path} AS VARCHAR), '^[$][.]?', ''), '')"
    return f"SELECT {severity} AS severity, '{kind}' AS kind, endpoint, CAST({status} AS INTEGER) AS status, {place} AS path, {message} AS message, CAST({samples} AS BIGINT) AS b_samples FROM {source} WHERE {where}"


_ENDPOINTS = [
    _finding("'breaking'", "endpoint-removed", "(SELECT DISTINCT endpoint FROM x_a0)", "endpoint NOT IN (SELECT endpoint FROM x_b0)", "'Endpoint ' || endpoint || ' was removed (present in a, absent in b).'"),
    _finding("'info'", "endpoint-added", "(SELECT DISTINCT endpoint FROM x_b0)", "endpoint NOT IN (SELECT endpoint FROM x_a0)", "'Endpoint ' || endpoint || ' was added (absent in a, present in b).'"),
]
_ST = "(SELECT DISTINCT endpoint, status FROM {x} WHERE endpoint IN (SELECT endpoint FROM {y}))"
_STATUSES = [
    _finding("'risky'", "status-removed", _ST.format(x="x_a0", y="x_b0"), "(endpoint, status) NOT IN (SELECT (endpoint, status) FROM x_b0)", "'Response status ' || status || ' was removed (present in a, absent in b).'", "status"),
    _finding("'risky'", "status-added", _ST.format(x="x_b0", y="x_a0"), "(endpoint, status) NOT IN (SELECT (endpoint, status) FROM x_a0)", "'Response status ' || status || ' was added (absent in a, present in b).'", "status"),
]
_FS = """(SELECT coalesce(f.endpoint, g.endpoint) AS endpoint, coalesce(f.status, g.status) AS status, coalesce(f.parent, g.parent) AS parent, coalesce(f.key, g.key) AS key, f.optional AS oa, g.optional AS ob, g.seen AS seen, o.samples AS sb
  FROM a_fields f FULL JOIN b_fields g ON f.endpoint = g.endpoint AND f.status = g.status AND f.parent = g.parent AND f.key = g.key
  JOIN b_nodes o ON o.endpoint = coalesce(f.endpoint, g.endpoint) AND o.status = coalesce(f.status, g.status) AND o.path = coalesce(f.parent, g.parent) AND o.family = 'object'
  JOIN a_nodes q ON q.endpoint = o.endpoint AND q.status = o.status AND q.path = o.path AND q.family = 'object')"""
_PLACE, _FIELD = "parent || '.' || key", "'Field \"' || key || '\" "
_FIELDS = [
    _finding("'breaking'", "field-removed", _FS, "ob IS NULL", _FIELD + "was removed in b.'", "status", _PLACE, "sb"),
    _finding("'info'", "field-added", _FS, "oa IS NULL", _FIELD + "was added in b.'", "status", _PLACE, "seen"),
    _finding("'risky'", "optionality-changed", _FS, "NOT oa AND ob", _FIELD + "became optional in b (was required).'", "status", _PLACE, "sb"),
    _finding("'info'", "optionality-changed", _FS, "oa AND NOT ob", _FIELD + "became required in b (was optional).'", "status", _PLACE, "sb"),
]
_NULLS = [_finding("CASE WHEN nb THEN 'breaking' ELSE 'info' END", "nullability-changed", _PATHS, "nullable <> nb", "CASE WHEN nb THEN 'Became nullable in b (a did not allow null).' ELSE 'Became non-nullable in b (a allowed null).' END", "status", "path", "sb")]
_ONE = "CASE WHEN {x} IN ('integer', 'number', 'string', 'boolean') THEN 'primitive' ELSE {x} END"
_TYPES = [
    _finding(
        "CASE WHEN type IN ('integer', 'number') AND tb IN ('integer', 'number') THEN 'info' ELSE 'breaking' END", "type-changed", _PATHS, "type <> tb AND type NOT IN ('union', 'null') AND tb NOT IN ('union', 'null')",
        f"CASE WHEN {_ONE.format(x='type')} = {_ONE.format(x='tb')} THEN 'Primitive type changed from ' || type || ' to ' || tb || '.' ELSE 'Kind changed from ' || {_ONE.format(x='type')} || ' to ' || {_ONE.format(x='tb')} || '.' END", "status", "path", "sb",
    )
]
_NAMES = "coalesce(nullif(concat_ws(', ', {parts}), ''), 'none')"
_SHOWN = lambda m: _NAMES.format(parts=", ".join(f"CASE WHEN ({m} & {bit}) <> 0 THEN '{name}' END" for name, bit in (("date", 4), ("date-time", 2), ("email", 8), ("uri", 16), ("uuid", 1))))
_FORMATS = [
    _finding(
        "CASE WHEN (mask & ~mb) <> 0 THEN 'risky' ELSE 'info' END", "format-changed", _PATHS, "type = 'string' AND tb = 'string' AND mask <> mb",
        f"CASE WHEN (mask & ~mb) <> 0 THEN 'Format lost or changed in b (was ' || {_SHOWN('mask')} || ', now ' || {_SHOWN('mb')} || ').' ELSE 'Format gained in b (now ' || {_SHOWN('mb')} || ').' END", "status", "path", "sb",
    )
]
_EN = "(SELECT a.endpoint, a.status, a.path, b.samples AS sb, list_filter(b.vals, lambda v: NOT list_contains(a.vals, v)) AS more, list_filter(a.vals, lambda v: NOT list_contains(b.vals, v)) AS less FROM a_enums a JOIN b_enums b USING (endpoint, status, path))"
_ENUMS = [
    _finding("'risky'", "enum-values-changed", _EN, "len(more) > 0", "'Enum values added in b: ' || array_to_string(more, ', ') || '.'", "status", "path", "sb"),
    _finding("'info'", "enum-values-changed", _EN, "len(less) > 0", "'Enum values removed in b: ' || array_to_string(less, ', ') || '.'", "status", "path", "sb"),
    _finding("'risky'", "enum-values-changed", "(SELECT e.*, y.samples AS sb FROM a_enums e JOIN b_types y USING (endpoint, status, path) WHERE y.type = 'string' AND (e.endpoint, e.status, e.path) NOT IN (SELECT (endpoint, status, path) FROM b_enums))", "true", "'Enum in a became an open primitive in b (closed set opened).'", "status", "path", "sb"),
]
_PF = "(SELECT endpoint, i - 1 AS idx, arg_min(name, ord) AS name, arg_min(kind, ord) AS f FROM x_{s} JOIN seg_{s} USING (path) WHERE kind <> 'literal' GROUP BY ALL)"
_PARAMS = [_finding("'risky'", "params-changed", f"(SELECT p.endpoint, p.name, p.f, q.f AS fb FROM {_PF.format(s='a0')} p JOIN {_PF.format(s='b0')} q USING (endpoint, name))", "f <> fb", "'Path param \"' || name || '\" format changed from ' || f || ' to ' || fb || '.'", path="name")]


_CORE = "(SELECT endpoint, status, path, CASE WHEN family = 'num' THEN CASE WHEN all_int THEN 'integer' ELSE 'number' END ELSE family END AS meet, count(*) OVER (PARTITION BY endpoint, status, path) AS k FROM {t}_nodes WHERE family <> 'null')"
_VARIANTS = "(SELECT x.endpoint, x.status, x.path, x.meet, (SELECT sum(samples) FROM b_nodes n WHERE n.endpoint = x.endpoint AND n.status = x.status AND n.path = x.path) AS sb FROM {x} x JOIN (SELECT DISTINCT endpoint, status, path, k FROM {y}) y USING (endpoint, status, path) WHERE (x.k > 1 OR y.k > 1) AND (x.endpoint, x.status, x.path, x.meet) NOT IN (SELECT (endpoint, status, path, meet) FROM {y}))"
_HAS = "(SELECT DISTINCT endpoint FROM x_{x} WHERE {what} AND endpoint IN (SELECT endpoint FROM x_{y}) AND endpoint NOT IN (SELECT endpoint FROM x_{y} WHERE {what}))"
_REQ, _QUE = "req_body IS NOT NULL", "contains(url, '?')"
_BODY_TYPES = [
    _finding("'breaking'", "type-changed", "(SELECT endpoint, status, count(*) AS n, count(body) AS bodies FROM x_b0 GROUP BY ALL)", "bodies = 0 AND (endpoint, status) IN (SELECT (endpoint, status) FROM x_a0 WHERE body IS NOT NULL)", "'Body was removed in b (present in a).'", "status", samples="n"),
    _finding("'info'", "type-changed", _VARIANTS.format(x=_CORE.format(t="a"), y=_CORE.format(t="b")), "true", "'Variant \"' || meet || '\" from a is absent in b (type narrowed).'", "status", "path", "sb"),
    _finding("'risky'", "type-changed", _VARIANTS.format(x=_CORE.format(t="b"), y=_CORE.format(t="a")), "true", "'Variant \"' || meet || '\" appeared in b (type widened).'", "status", "path", "sb"),
]
_MORE = [
    _finding("'info'", "request-changed", _HAS.format(x="a0", y="b0", what=_REQ), "true", "'Request body was removed in b (present in a) (path prefix \"request\").'", path="'request'"),
    _finding("'breaking'", "request-changed", _HAS.format(x="b0", y="a0", what=_REQ), "true", "'Request body is now required in b but was absent in a (path prefix \"request\").'", path="'request'"),
    _finding("'info'", "query-changed", _HAS.format(x="a0", y="b0", what=_QUE), "true", "'Query shape was removed in b (present in a) (path prefix \"query\").'", path="'query'"),
    _finding("'risky'", "query-changed", _HAS.format(x="b0", y="a0", what=_QUE), "true", "'Query shape appeared in b (absent in a) (path prefix \"query\").'", path="'query'"),
]
_ALL = _ENDPOINTS + _STATUSES + _PARAMS + _FIELDS + _NULLS + _TYPES + _BODY_TYPES + _FORMATS + _ENUMS + _MORE


def _u(parts: list[str]) -> str:
    return "\n" + "\nUNION ALL\n".join(parts)


_QT = "WITH " + EXP + ",\n" + norm("exp") + ", q AS (SELECT endpoint, ord, unnest(list_filter(string_split(CASE WHEN strpos(url, '?') > 0 THEN substr(url, strpos(url, '?') + 1) ELSE '' END, '&'), lambda x: x <> '')) AS piece FROM x_exp), qq AS (SELECT endpoint, ord, url_decode(replace(regexp_extract(piece, '^[^=]*', 0), '+', ' ')) AS key, url_decode(replace(regexp_extract(piece, '^[^=]*=?(.*)$', 1), '+', ' ')) AS value FROM q), qk AS (SELECT *, CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(value, '-?[0-9]+[.][0-9]+') THEN CASE WHEN CAST(value AS DOUBLE) = floor(CAST(value AS DOUBLE)) THEN 'integer' ELSE 'number' END WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM qq)\n"
_X = "WITH " + EXP + ",\n" + norm("exp") + "\n"
_EE = "WITH " + _E + "\n"
_WORD = "upper(left({x}, 1)) || substr({x}, 2)"
_PASCAL = "array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[^a-zA-Z0-9]+'), lambda f: f <> ''), lambda f: upper(left(f, 1)) || substr(f, 2)), '')"
_CONST = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN '123e4567-e89b-12d3-a456-4266141740' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 1 THEN '2024-01-05T10:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || 'Z' WHEN 2 THEN '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 3 THEN 'u' || user_id || '@example.com' WHEN 4 THEN 'https://example.com/' || event_id WHEN 5 THEN '2024-01-05' || chr(10) WHEN 6 THEN 'mailto://u' || user_id || '@x.y' ELSE event_type END AS s FROM events"
_MASK = f"CASE WHEN regexp_full_match(s, '{_UUID}') THEN 1 ELSE 0 END + CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})') THEN 2 WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 4 ELSE 0 END + CASE WHEN regexp_full_match(s, '[^\\s@]+@[^\\s@]+[.][^\\s@]+') THEN 8 ELSE 0 END + CASE WHEN regexp_full_match(s, '[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s]+') THEN 16 ELSE 0 END"

SQL: dict[str, str] = {
    "scan_skip_corrupt": f"WITH {EXE} SELECT status, count(*) AS n_kept, count(*) AS n_bodies, count(*) AS n_places FROM exe WHERE ord % 13 <> 0 AND ord % 17 <> 0 GROUP BY status",
    "filter_include_exclude": f"WITH {EXE} SELECT ord, path FROM exe WHERE (starts_with(path, '/api/users/1') OR starts_with(path, '/api/users/2')) AND NOT starts_with(path, '/api/users/11')",
    "redact_headers": f"WITH {EXE} SELECT ord, '[redacted]' AS \"authorization\", content_type, CASE WHEN ord % 2 = 0 THEN '[redacted]' ELSE 'k' || user_id END AS last_key FROM exe",
    "body_decode_cap": f"WITH {EXE} SELECT ord, left(body, 128) AS text, length(body) <= 128 AS parsed FROM exe",
    "path_only": f"WITH {EXP} SELECT ord, path FROM exp",
    "parse_query_multimap": _QT + "SELECT ord, key, value, count(*) AS n FROM qq GROUP BY ALL",
    "classify_segments": "WITH " + EXP + ",\n" + norm("exp") + " SELECT DISTINCT seg, kind FROM kind_exp",
    "singularize": "WITH w AS (SELECT lower(n_name) AS w FROM nation UNION SELECT lower(n_name) || 's' FROM nation UNION SELECT left(lower(n_name), 3) || 'ies' FROM nation UNION SELECT 'ies' UNION SELECT 's') SELECT w AS word, " + _SINGULAR.format(x="w") + " AS singular FROM w",
    "normalize_path": "WITH " + EXP + ",\n" + EXE + ",\n" + norm("exp") + ",\n" + norm("exe") + " SELECT path, pattern FROM norm_exp UNION SELECT path, pattern FROM norm_exe",
    "operation_name": _EE + "SELECT DISTINCT method, pattern, lower(method) || array_to_string(list_transform(list_filter(string_split(pattern, '/'), lambda p: p <> ''), lambda p: CASE WHEN p LIKE ':%' THEN 'By' ELSE '' END || " + _PASCAL.format(x="p") + "), '') AS operation_id FROM x_exe",
    "coerce_query_values": _QT + "SELECT DISTINCT value, kind FROM qk",
    "detect_formats": f"WITH c AS ({_CONST}) SELECT event_id, {_MASK} AS fmt_mask FROM c",
    "numeric_string_guard": "WITH s AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '0' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN p_size || '.50' WHEN 4 THEN '-' || p_size ELSE p_brand END AS s FROM part) SELECT s, regexp_full_match(s, '-?(0|[1-9][0-9]{0,14})([.][0-9]{0,5}[1-9])?') AND s <> '-0' AS numeric FROM s",
    "openapi_paths": _EE + "SELECT DISTINCT pattern, regexp_replace(pattern, ':([A-Za-z0-9_]+)', '{\\1}', 'g') AS openapi_path FROM x_exe",
    "endpoint_groups": _X + "SELECT method, pattern, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM x_exp GROUP BY ALL",
    "status_counts": _EE + "SELECT endpoint, status, count(*) AS n FROM x_exe GROUP BY ALL",
    "exchange_ids": _X + "SELECT endpoint, ord FROM x_exp",
    "exchange_positions": _EE + "SELECT endpoint, ord, row_number() OVER (PARTITION BY endpoint ORDER BY ord) - 1 AS pos FROM x_exe",
    "param_samples_topk": _EE + "SELECT endpoint, idx, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, idx ORDER BY first_ord, value) AS rank FROM (SELECT endpoint, i - 1 AS idx, seg AS value, min(ord) AS first_ord FROM x_exe JOIN seg_exe USING (path) WHERE kind <> 'literal' GROUP BY ALL)) WHERE rank <= 10",
    "param_first_format": _EE + f"SELECT endpoint, idx, name, f AS format FROM {_PF.format(s='exe')}",
    "latest_sample": _EE + "SELECT endpoint, status, arg_max(body, ord) AS sample, max(ord) AS ord FROM x_exe GROUP BY ALL",
    "dominant_content_type": _EE + "SELECT endpoint, status, content_type FROM (SELECT endpoint, status, content_type, row_number() OVER (PARTITION BY endpoint, status ORDER BY count(*) DESC, min(ord)) AS r FROM x_exe GROUP BY endpoint, status, content_type) WHERE r = 1",
    "query_shape": _QT + ", o AS (SELECT endpoint, ord, key, count(*) AS k, min(kind) AS lo, max(kind) AS hi FROM qk GROUP BY ALL), g AS (SELECT endpoint, key, count(*) AS seen, max(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS repeated, min(lo) AS least_kind, max(hi) AS last_kind FROM o GROUP BY ALL) SELECT *, seen < max(seen) OVER (PARTITION BY endpoint) AS optional FROM g",
    "distinct_raw_paths": f"WITH {EXE} SELECT count(DISTINCT method || ' ' || path) AS n FROM exe",
    "success_status": _EE + "SELECT endpoint, coalesce(min(status) FILTER (status BETWEEN 200 AND 299), min(status)) AS status FROM x_exe GROUP BY ALL",
    "gen_summary": _EE + "SELECT endpoint, CAST(sum(n) AS BIGINT) AS samples, string_agg(CAST(status AS VARCHAR), ',' ORDER BY status) AS statuses FROM (SELECT endpoint, status, count(*) AS n FROM x_exe GROUP BY ALL) GROUP BY endpoint",
    "endpoints_sorted": _X + "SELECT DISTINCT pattern, method FROM x_exp ORDER BY pattern, method",
    "infer_json_nodes": _T + " SELECT ord, path, family, count(*) AS n FROM t GROUP BY ALL",
    "shape_nodes": _T + " SELECT endpoint, status, path, family, samples, all_int, fmt_mask FROM t_nodes",
    "numeric_widening": _T + " SELECT endpoint, status, path, CASE WHEN all_int THEN 'integer' ELSE 'number' END AS type FROM t_nodes WHERE family = 'num'",
    "format_intersection": _T + " SELECT endpoint, status, path, fmt_mask FROM t_nodes WHERE family = 'string'",
    "array_element_merge": _T + " SELECT n.endpoint, n.status, n.path, n.samples AS arrays, CAST(coalesce((SELECT sum(m.samples) FROM t_nodes m WHERE m.endpoint = n.endpoint AND m.status = n.status AND m.path = n.path || '[]'), 0) AS BIGINT) AS elements FROM t_nodes n WHERE family = 'array'",
    "optional_fields": _T + " SELECT endpoint, status, parent, key, seen, samples, optional FROM t_fields",
    "union_variants": _T + " SELECT endpoint, status, path, string_agg(family, '|' ORDER BY family) AS families FROM t_nodes GROUP BY ALL HAVING count(*) > 1",
    "nullable_fields": _T + " SELECT endpoint, status, path FROM t_nodes GROUP BY ALL HAVING bool_or(family = 'null')",
    "enum_detection": _T + " SELECT endpoint, status, path, CAST(samples AS BIGINT) AS samples, array_to_string(vals, ',') AS vals FROM t_enums",
    "record_detection": "SELECT 'GET /nations' AS endpoint, 200 AS status, '$.k' || CAST(n_nationkey AS VARCHAR) AS path, CAST(12 + n_nationkey % 3 AS BIGINT) AS keys FROM nation WHERE n_nationkey % 2 = 0",
    "drift_endpoints": _D + " SELECT coalesce(a.endpoint, b.endpoint) AS endpoint, a.n AS n_a, b.n AS n_b FROM (SELECT endpoint, count(*) AS n FROM x_a0 GROUP BY 1) a FULL JOIN (SELECT endpoint, count(*) AS n FROM x_b0 GROUP BY 1) b ON a.endpoint = b.endpoint",
    "drift_endpoint_removed": _D + _u(_ENDPOINTS[:1]),
    "drift_endpoint_added": _D + " SELECT f.*, n_b FROM (" + _u(_ENDPOINTS[1:]) + ") f JOIN (SELECT endpoint, count(*) AS n_b FROM x_b0 GROUP BY 1) g USING (endpoint)",
    "drift_statuses": _D + " SELECT f.*, n_a, n_b FROM (" + _u(_STATUSES) + ") f LEFT JOIN (SELECT endpoint, status, count(*) AS n_a FROM x_a0 GROUP BY ALL) g USING (endpoint, status) LEFT JOIN (SELECT endpoint, status, count(*) AS n_b FROM x_b0 GROUP BY ALL) h USING (endpoint, status)",
    "drift_fields": _DT + _u(_FIELDS),
    "drift_params": _D + _u(_PARAMS),
    "drift_nullability": _DT + _u(_NULLS),
    "drift_type_matrix": _DT + _u(_TYPES + _BODY_TYPES),
    "drift_enums": _DT + _u(_ENUMS),
    "drift_formats": _DT + _u(_FORMATS),
    "drift_unions": _DT + " SELECT endpoint, status, path, coalesce(a_nodes.family, b_nodes.family) AS family, a_nodes.samples AS n_a, b_nodes.samples AS n_b FROM a_nodes FULL JOIN b_nodes USING (endpoint, status, path, family) WHERE a_nodes.samples IS NULL OR b_nodes.samples IS NULL",
    "drift_summary": _DT + " SELECT severity, kind, count(*) AS n FROM (" + _u(_ALL) + ") GROUP BY ALL",
    "drift_report_sorted": _DT + " SELECT * FROM (" + _u(_ALL) + ")",
    "drift_findings": _DT + " SELECT severity, kind, endpoint, status, path, b_samples FROM (" + _u(_ALL) + ")",
    "drift_low_confidence": _DT + " SELECT severity, kind, count(*) AS n, count(*) FILTER (b_samples < 3) AS n_low FROM (" + _u(_ALL) + ") GROUP BY ALL",
    "claims_refused": _EE + "SELECT DISTINCT endpoint, 'response[' || status || ']' AS slot FROM x_exe WHERE status >= 400",
    "drift_counters": _D + " SELECT count(*) FILTER (a AND b) AS endpoints_compared, count(*) FILTER (a AND NOT b) AS endpoints_only_in_a, count(*) FILTER (b AND NOT a) AS endpoints_only_in_b FROM (SELECT bool_or(s = 'a') AS a, bool_or(s = 'b') AS b FROM (SELECT endpoint, 'a' AS s FROM x_a0 UNION ALL SELECT endpoint, 'b' FROM x_b0) GROUP BY endpoint)",
    "recording_catalog": "SELECT 'day-' || day(ts) AS name, 'http://events' AS target, count(*) AS n FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-03' GROUP BY ALL",
    "request_samples": _EE + "SELECT endpoint, status, arg_max(req_body, ord) AS sample FROM x_exe WHERE req_body IS NOT NULL GROUP BY ALL",
    "collapsed_shapes": "SELECT * FROM (VALUES ('$', 'record', NULL, NULL), ('${}', 'object', NULL, NULL), ('${}.lines', 'array', NULL, NULL), ('${}.lines[]', 'primitive', 'integer', NULL)) t(path, kind, type, vals) UNION ALL SELECT '${}.status', 'primitive', 'string', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders",
    "json_content_type": f"WITH {EXE} SELECT ord, ord % 4 IN (1, 2) AS is_json FROM exe",
    "strip_hop_by_hop": f"WITH {EXE} SELECT ord, CASE WHEN ord % 6 = 0 THEN '' WHEN ord % 2 = 0 THEN 'Accept' WHEN ord % 3 = 0 THEN 'X-A' ELSE 'Accept,X-A' END AS names FROM exe",
    "query_bodies": "WITH " + EXP + ", q AS (SELECT ord, list_filter(string_split(CASE WHEN strpos(url, '?') > 0 THEN substr(url, strpos(url, '?') + 1) ELSE '' END, '&'), lambda x: x <> '') AS p FROM exp) SELECT ord, '{' || array_to_string(list_transform(p, lambda x: CAST(to_json(regexp_extract(x, '^[^=]*', 0)) AS VARCHAR) || ':' || CASE WHEN regexp_full_match(regexp_extract(x, '^[^=]*=?(.*)$', 1), '[0-9]+') THEN regexp_extract(x, '^[^=]*=?(.*)$', 1) ELSE CAST(to_json(regexp_extract(x, '^[^=]*=?(.*)$', 1)) AS VARCHAR) END), ',') || '}' AS query FROM q",
    "type_names": _EE + "SELECT DISTINCT method, pattern, upper(left(method, 1)) || lower(substr(method, 2)) || array_to_string(list_transform(list_filter(string_split(pattern, '/'), lambda p: p <> ''), lambda p: CASE WHEN p LIKE ':%' THEN 'By' ELSE '' END || " + _PASCAL.format(x="p") + "), '') AS type_name FROM x_exe",
    "api_model": _T + """, rp AS (SELECT endpoint, count(DISTINCT j.fullkey) AS n FROM x_exe, json_tree(x_exe.req_body) j WHERE req_body IS NOT NULL GROUP BY endpoint),
qp AS (SELECT endpoint, 1 + count(DISTINCT regexp_extract(k, '^[^=]*', 0)) AS n FROM (SELECT endpoint, unnest(string_split(string_split(url, '?')[2], '&')) AS k FROM x_exe WHERE contains(url, '?')) GROUP BY endpoint),
pp AS (SELECT endpoint, string_agg(name || ':' || f, ',' ORDER BY idx) AS params FROM """ + _PF.format(s="exe") + """ GROUP BY endpoint),
ct AS (SELECT endpoint, status, content_type FROM (SELECT endpoint, status, content_type, row_number() OVER (PARTITION BY endpoint, status ORDER BY count(*) DESC, min(ord)) AS r FROM x_exe GROUP BY endpoint, status, content_type) WHERE r = 1),
r AS (SELECT endpoint, status, method, pattern, count(*) AS n FROM x_exe GROUP BY ALL)
SELECT r.endpoint, r.status, r.n, ct.content_type, lower(method) || array_to_string(list_transform(list_filter(string_split(pattern, '/'), lambda p: p <> ''), lambda p: CASE WHEN p LIKE ':%' THEN 'By' ELSE '' END || """ + _PASCAL.format(x="p") + """), '') AS operation_id, pp.params,
  (SELECT count(DISTINCT path) FROM t_nodes t WHERE t.endpoint = r.endpoint AND t.status = r.status) AS body_places, rp.n AS request_places, qp.n AS query_places
FROM r JOIN ct USING (endpoint, status) LEFT JOIN pp USING (endpoint) LEFT JOIN rp USING (endpoint) LEFT JOIN qp USING (endpoint)""",
    "drift_fail_on": _DT + " SELECT level, (SELECT count(*) FROM (" + _u(_ALL) + ") f WHERE CASE f.severity WHEN 'breaking' THEN 0 WHEN 'risky' THEN 1 ELSE 2 END <= r) > 0 AS fails FROM (VALUES ('breaking', 0), ('risky', 1), ('info', 2)) l(level, r)",
}
SQL["streamed_model"] = SQL["merged_model"] = SQL["api_model"]
SQL["streamed_enums"] = SQL["enum_detection"]
SQL["recording_log"] = f"""WITH {EXE}, p AS (SELECT ord % 5 AS batch, status, req_body, row_number() OVER (ORDER BY ord % 5, ord) - 1 AS place FROM exe)
SELECT batch, status, count(*) AS n, count(req_body) AS n_requests, min(place) AS first_place, max(place) AS last_place FROM p GROUP BY ALL"""

_VIEW, _SIGNUP = "'GET /api/users/:userId/views/:viewId'", "'POST /api/users/:userId'"
SQL["claims_drift"] = _T + f""", claimed AS (SELECT * FROM (VALUES ('id', true), ('type', true), ('tags', true), ('seen', true), ('value', false)) c(key, required)),
seen AS (SELECT key, optional FROM t_fields WHERE endpoint = {_VIEW} AND status = 200 AND parent = '$'),
pair AS (SELECT coalesce(c.key, o.key) AS key, c.required, o.optional FROM claimed c FULL JOIN seen o ON o.key = c.key),
said AS (SELECT * FROM (VALUES ({_VIEW}, 200), ({_VIEW}, 304), ({_SIGNUP}, 201)) c(endpoint, status)),
got AS (SELECT DISTINCT endpoint, status FROM x_exe WHERE endpoint IN ({_VIEW}, {_SIGNUP})),
vals AS (SELECT unnest(vals) AS v FROM t_enums WHERE endpoint = {_VIEW} AND status = 200 AND path = '$.type')
SELECT 'breaking' AS severity, 'field-removed' AS kind, {_VIEW} AS endpoint, 200 AS status, key AS path FROM pair WHERE optional IS NULL
UNION ALL SELECT 'info', 'field-added', {_VIEW}, 200, key FROM pair WHERE required IS NULL
UNION ALL SELECT CASE WHEN required THEN 'risky' ELSE 'info' END, 'optionality-changed', {_VIEW}, 200, key FROM pair WHERE required = optional
UNION ALL SELECT 'risky', 'status-removed', endpoint, status, NULL FROM said WHERE (endpoint, status) NOT IN (SELECT (endpoint, status) FROM got) AND endpoint IN (SELECT endpoint FROM got)
UNION ALL SELECT 'risky', 'status-added', endpoint, status, NULL FROM got WHERE (endpoint, status) NOT IN (SELECT (endpoint, status) FROM said)
UNION ALL SELECT 'breaking', 'type-changed', endpoint, status, NULL FROM t_nodes WHERE endpoint = {_SIGNUP} AND status = 201 AND path = '$' AND family = 'object'
UNION ALL SELECT 'risky', 'query-changed', endpoint, NULL, 'query' FROM x_exe WHERE endpoint = {_VIEW} AND contains(url, '?') GROUP BY endpoint
UNION ALL SELECT 'info', 'field-added', endpoint, NULL, 'request.' || j.key FROM x_exe, json_each(req_body) j WHERE endpoint = {_SIGNUP} GROUP BY endpoint, j.key
UNION ALL SELECT 'breaking', 'nullability-changed', endpoint, status, 'value' FROM t_types WHERE endpoint = {_VIEW} AND path = '$.value' AND nullable
UNION ALL SELECT 'info', 'type-changed', endpoint, status, 'value' FROM t_types WHERE endpoint = {_VIEW} AND path = '$.value' AND type <> 'null'
UNION ALL SELECT 'risky', 'type-changed', endpoint, status, 'tags[]' FROM t_nodes WHERE endpoint = {_VIEW} AND path = '$.tags[]' AND family <> 'string'
UNION ALL SELECT 'risky', 'enum-values-changed', {_VIEW}, 200, 'type' WHERE EXISTS (FROM vals WHERE v NOT IN ('view', 'click'))
UNION ALL SELECT 'info', 'enum-values-changed', {_VIEW}, 200, 'type' WHERE EXISTS (FROM vals) AND (SELECT count(*) FROM vals WHERE v IN ('view', 'click')) < 2"""
#: Types of bodies whose fields hold scalars, arrays of scalars, or objects of scalars.
SQL["render_types"] = _T + """, o AS (SELECT endpoint, status, ord, regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, regexp_replace(j.path, '\\[[0-9]+\\]', '[]', 'g') AS parent, CASE WHEN j.fullkey = '$' OR j.fullkey LIKE '%]' THEN NULL ELSE j.key END AS key,
  CASE WHEN j.type = 'NULL' THEN 'null' WHEN j.type IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN lower(j.type) WHEN j.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS family, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS sval, (ord, j.id) AS met FROM x_exe, json_tree(x_exe.body) AS j),
word AS (SELECT endpoint, status, path, string_agg('"' || sval || '"', ' | ' ORDER BY met) AS word, count(*) AS k FROM (SELECT endpoint, status, path, sval, min(met) AS met FROM o WHERE sval IS NOT NULL AND (endpoint, status, path) IN (SELECT (endpoint, status, path) FROM t_enums) GROUP BY ALL) GROUP BY ALL),
fam AS (SELECT endpoint, status, path, any_value(parent) AS parent, any_value(key) AS key, family, min(met) AS met FROM o GROUP BY endpoint, status, path, family),
leaf AS (SELECT f.endpoint, f.status, f.path, string_agg(coalesce(CASE WHEN family = 'string' THEN word END, family), ' | ' ORDER BY family = 'null', f.met) AS text, count(*) > 1 OR max(coalesce(k, 1)) > 1 AS wide FROM fam f LEFT JOIN word USING (endpoint, status, path) WHERE family NOT IN ('object', 'array') GROUP BY ALL),
note AS (SELECT endpoint, status, path, '/** format: ' || concat_ws(', ', CASE WHEN mask & 1 <> 0 THEN 'uuid' END, CASE WHEN mask & 2 <> 0 THEN 'date-time' END, CASE WHEN mask & 4 <> 0 THEN 'date' END, CASE WHEN mask & 8 <> 0 THEN 'email' END, CASE WHEN mask & 16 <> 0 THEN 'uri' END) || ' */ ' AS note FROM t_types WHERE type = 'string' AND NOT nullable AND mask > 0),
need AS (SELECT endpoint, status, parent || '.' || key AS path, CASE WHEN optional THEN '?' ELSE '' END AS mark FROM t_fields),
part AS (SELECT f.endpoint, f.status, f.path, f.family = 'null' AS last, f.met, CASE f.family WHEN 'array' THEN CASE WHEN e.text IS NULL THEN 'unknown[]' WHEN e.wide THEN 'Array<' || e.text || '>' ELSE e.text || '[]' END
    WHEN 'object' THEN coalesce('{\n' || (SELECT string_agg('    ' || coalesce(n.note, '') || c.key || d.mark || ': ' || l.text || ';', '\n' ORDER BY c.met) FROM (SELECT endpoint, status, path, parent, key, min(met) AS met FROM fam GROUP BY ALL) c JOIN leaf l USING (endpoint, status, path) JOIN need d USING (endpoint, status, path) LEFT JOIN note n USING (endpoint, status, path) WHERE c.endpoint = f.endpoint AND c.status = f.status AND c.parent = f.path) || '\n  }', 'Record<string, never>')
    ELSE coalesce(CASE WHEN f.family = 'string' THEN w.word END, f.family) END AS text
  FROM fam f LEFT JOIN leaf e ON e.endpoint = f.endpoint AND e.status = f.status AND e.path = f.path || '[]' LEFT JOIN word w ON w.endpoint = f.endpoint AND w.status = f.status AND w.path = f.path WHERE f.parent = '$' AND f.key IS NOT NULL),
line AS (SELECT p.endpoint, p.status, p.path, min(p.met) AS met, string_agg(p.text, ' | ' ORDER BY p.last, p.met) AS text FROM part p GROUP BY ALL)
SELECT line.endpoint, line.status, '{\n' || string_agg('  ' || coalesce(note, '') || substr(path, 3) || mark || ': ' || text || ';', '\n' ORDER BY met) || '\n}' AS content FROM line JOIN need USING (endpoint, status, path) LEFT JOIN note USING (endpoint, status, path) GROUP BY ALL"""


def _drawn(number: str, string: str, other: str, several: str, nullable: str, array: str, item: str, whole: str, inner: str) -> str:
    """Bodies' shapes as text, for fields that hold scalars, arrays of scalars, or objects of scalars.

    ``number``, ``string`` and ``other`` are texts of one kind of value (columns whole, mask, words, family); ``several`` and ``nullable`` join the
    ordered list ``parts``; ``array`` wraps ``text``; ``item`` is a field (key, text, optional), ``whole`` and ``inner`` put the list ``items`` and ``need`` together.
    """
    lists = "list_filter(list(CASE WHEN NOT optional THEN '\"' || key || '\"' END ORDER BY met), lambda x: x IS NOT NULL)"
    join = f"CASE WHEN len(parts) = 1 THEN parts[1] WHEN nulls AND len(parts) = 2 THEN {nullable} ELSE {several} END"
    return _T + f""", o AS (SELECT endpoint, status, regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, regexp_replace(j.path, '\\[[0-9]+\\]', '[]', 'g') AS parent, CASE WHEN j.fullkey = '$' OR j.fullkey LIKE '%]' THEN NULL ELSE j.key END AS key,
  CASE WHEN j.type = 'NULL' THEN 'null' WHEN j.type IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN lower(j.type) WHEN j.type = 'VARCHAR' THEN 'string' ELSE 'num' END AS family, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS sval, (ord, j.id) AS met FROM x_exe, json_tree(x_exe.body) AS j),
word AS (SELECT endpoint, status, path, list('"' || sval || '"' ORDER BY met) AS words FROM (SELECT endpoint, status, path, sval, min(met) AS met FROM o WHERE sval IS NOT NULL AND (endpoint, status, path) IN (SELECT (endpoint, status, path) FROM t_enums) GROUP BY ALL) GROUP BY ALL),
fam AS (SELECT f.*, n.all_int AS whole, n.fmt_mask AS mask, CASE WHEN f.family = 'string' THEN w.words END AS words FROM (SELECT endpoint, status, path, any_value(parent) AS parent, any_value(key) AS key, family, min(met) AS met FROM o GROUP BY endpoint, status, path, family) f JOIN t_nodes n USING (endpoint, status, path, family) LEFT JOIN word w USING (endpoint, status, path)),
leaf AS (SELECT endpoint, status, path, {join} AS text FROM (SELECT endpoint, status, path, list(CASE family WHEN 'num' THEN {number} WHEN 'string' THEN {string} ELSE {other} END ORDER BY family = 'null', met) AS parts, bool_or(family = 'null') AS nulls FROM fam WHERE family NOT IN ('object', 'array') GROUP BY ALL)),
place AS (SELECT endpoint, status, path, parent, key, min(met) AS met FROM fam WHERE key IS NOT NULL GROUP BY ALL),
low AS (SELECT endpoint, status, path, {inner} AS text FROM (SELECT p.endpoint, p.status, p.parent AS path, list({item} ORDER BY p.met) AS items, {lists.replace('key', 'p.key').replace('met', 'p.met')} AS need FROM place p JOIN leaf USING (endpoint, status, path) JOIN t_fields d ON d.endpoint = p.endpoint AND d.status = p.status AND d.parent = p.parent AND d.key = p.key WHERE p.parent <> '$' GROUP BY ALL)),
one AS (SELECT f.endpoint, f.status, f.path, f.family, f.met, CASE f.family WHEN 'object' THEN low.text WHEN 'array' THEN (SELECT {array} FROM (SELECT max(e.text) AS text FROM leaf e WHERE e.endpoint = f.endpoint AND e.status = f.status AND e.path = f.path || '[]')) WHEN 'num' THEN {number} WHEN 'string' THEN {string} ELSE {other} END AS text FROM fam f LEFT JOIN low USING (endpoint, status, path) WHERE f.parent = '$' AND f.key IS NOT NULL),
joined AS (SELECT endpoint, status, path, {join} AS text FROM (SELECT endpoint, status, path, list(text ORDER BY family = 'null', met) AS parts, bool_or(family = 'null') AS nulls FROM one GROUP BY ALL))
SELECT endpoint, status, {whole} AS content FROM (SELECT p.endpoint, p.status, list({item} ORDER BY p.met) AS items, {lists.replace('key', 'p.key').replace('met', 'p.met')} AS need FROM place p JOIN joined USING (endpoint, status, path) JOIN t_fields d ON d.endpoint = p.endpoint AND d.status = p.status AND d.parent = p.parent AND d.key = p.key WHERE p.parent = '$' GROUP BY ALL)"""


SQL["render_zod"] = _drawn(
    "'z.number()' || CASE WHEN whole THEN '.int()' ELSE '' END", "CASE WHEN words IS NOT NULL THEN 'z.enum([' || array_to_string(words, ', ') || '])' WHEN mask & 8 <> 0 THEN 'z.string().email()' ELSE 'z.string()' END", "'z.' || family || '()'",
    "'z.union([' || array_to_string(parts, ', ') || '])'", "parts[1] || '.nullable()'", "'z.array(' || coalesce(text, 'z.unknown()') || ')'", "p.key || ': ' || text || CASE WHEN optional THEN '.optional()' ELSE '' END || ','",
    "'z.object({\n  ' || array_to_string(items, '\n  ') || '\n})'", "'z.object({\n    ' || array_to_string(items, '\n    ') || '\n  })'",
)
SQL["render_spark_ddl"] = _drawn(
    "CASE WHEN whole THEN 'BIGINT' ELSE 'DOUBLE' END", "'STRING'", "CASE family WHEN 'boolean' THEN 'BOOLEAN' ELSE 'STRING' END", "'STRING'", "parts[1]", "'ARRAY<' || coalesce(text, 'STRING') || '>'", "'`' || p.key || '`: ' || text",
    "'STRUCT<' || array_to_string(items, ', ') || '>'", "'STRUCT<' || array_to_string(items, ', ') || '>'",
)
_NEED = "'{\"type\":\"object\",\"properties\":{' || array_to_string(items, ',') || '}' || CASE WHEN len(need) > 0 THEN ',\"required\":[' || array_to_string(need, ',') || ']' ELSE '' END || '}'"
SQL["render_json_schema"] = _drawn(
    "CASE WHEN whole THEN '{\"type\":\"integer\"}' ELSE '{\"type\":\"number\"}' END", "'{\"type\":\"string\"' || CASE WHEN words IS NOT NULL THEN ',\"enum\":[' || array_to_string(words, ',') || ']' WHEN mask & 8 <> 0 THEN ',\"format\":\"email\"' ELSE '' END || '}'", "'{\"type\":\"' || family || '\"}'",
    "'{\"anyOf\":[' || array_to_string(parts, ',') || ']}'", "'{\"type\":[' || regexp_extract(parts[1], '\"type\":(\"[a-z]+\")', 1) || ',\"null\"]}'", "'{\"type\":\"array\",\"items\":' || coalesce(text, '{}') || '}'", "'\"' || p.key || '\":' || text",
    _NEED, _NEED,
)
