"""Shapes of JSON bodies by aggregation over generalized paths.

A walker reads every body once and sends, for each Arrow batch, one row for each (place, kind of value): merging
shapes is then a set of aggregates that Spark computes partly in every task: sums, bool_and, bit_and,
and minima of (ord, pos) for order of first sight.  Values of strings ride along as long as they may still be a
closed vocabulary, at most ``ENUM_MAX`` + 1 for a place and batch, so no body's values are gathered twice.  A task
holds about ``HELD`` bytes of places, whatever a body or batch has of them, and of a long body's values those of a piece.

A place is written as its steps after ``SEP``: ``.key``, ``[]`` or ``{}``; the root is empty.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..tables import kept, spread

SEP = "\x1f"
ENUM_MAX, ENUM_MIN, RECORD_KEYS = 8, 4, 12
#: Levels of nesting that a body may have; a deeper one is refused and counted.  Types are drawn and dictionaries found level by level,
#: and a place's name grows with its depth.
MAX_DEPTH = 200
#: A body of more characters than ``LONG`` is parsed in pieces of about ``PIECE`` characters.
LONG, PIECE = 1 << 18, 1 << 16
#: About how many bytes of places a task holds before it sends them as rows.
HELD = 16 << 20
#: About how many bytes a place takes, without its name, and each of its listed values.
PLACE_BYTES, VALUE_BYTES = 1000, 300
#: Bytes of bodies that are read from a batch at once; one body at least.
READ = 4 << 20
#: The kind under which refused bodies are counted, at the root of their shape.
REFUSED = "refused"
_DEEP = object()
SLOTS = ("response", "request", "query")
OBS = "endpoint string, status int, ord long, path string, parent string, key string, family string, is_int boolean, fmt_mask int, sval string, pos int"
VALUES = "array<struct<v:string,n:long,ord:long,pos:int>>"
PARTS = (
    "endpoint string, slot string, status int, path string, parent string, key string, depth int, family string, n long, all_int boolean, fmt_mask int, "
    f"first_ord long, first_pos int, vals {VALUES}, open boolean"
)
SHAPE = ["endpoint", "slot", "status"]
_TOKEN = re.compile(formats.TOKEN)
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?")


def number_text(x: float) -> str:
    """A finite number as scripts print it: shortest digits, plain from 1e-6 up to 1e21."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = d.ljust(point, "0") if point >= len(d) else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + d
    else:
        text = f"{d[0]}{'.' if len(d) > 1 else ''}{d[1:]}e{point - 1:+d}"
    return "-" * sign + text


def is_numeric_text(value: str) -> bool:
    """Whether a token is the canonical writing of a number."""
    return bool(_NUMBER.fullmatch(value)) and abs(float(value)) < float("inf") and number_text(float(value)) == value


def _is_index(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and len(key) <= 10 and int(key) < 2**32 - 1


def _ordered(found: dict) -> list[tuple]:
    """Keys in order of first sight, the index-like first by number (of equal keys the last value is there already)."""
    index = [k for k in found if _is_index(k)]
    if not index:
        return list(found.items())
    return [(k, found[k]) for k in sorted(index, key=int)] + [(k, v) for k, v in found.items() if k not in set(index)]


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


_decoder = json.JSONDecoder(parse_constant=_constant)
_parse, _scan = _decoder.decode, _decoder.scan_once
_white = re.compile(r"[ \t\n\r]*").match


class TooDeep(ValueError):
    """JSON that is nested beyond ``MAX_DEPTH``."""


_MARKS = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]', re.DOTALL)


def nesting(text: str, most: int = MAX_DEPTH) -> int:
    """How deep brackets nest outside strings; counting ends beyond ``most``."""
    depth = deepest = 0
    for found in _MARKS.finditer(text):
        mark = found[0]
        if mark in "[{":
            depth += 1
            deepest = max(deepest, depth)
            if deepest > most:
                break
        elif mark in "]}":
            depth -= 1
    return deepest


def parse(text: str):
    """A JSON text's value; ValueError where it has none, ``TooDeep`` where it nests beyond ``MAX_DEPTH``.

    The depth is counted without recursion, and only where there are brackets enough.
    """
    if text.count("[") + text.count("{") > MAX_DEPTH and nesting(text) > MAX_DEPTH:
        raise TooDeep(f"nested deeper than {MAX_DEPTH} levels")
    return _parse(text)


def _clean(text: str) -> str:
    """Without lone surrogates, which Arrow can't hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def walk(text: str) -> list[tuple]:
    """(path, parent, key, family, is_int, fmt_mask, sval, pos) of every node, parents first; ``$`` is the root."""
    out: list[tuple] = []
    todo: list[tuple] = [("$", None, None, parse(text))]
    while todo:
        path, parent, key, value = todo.pop()
        family, whole, mask = family_of(value)
        inner = [(f"{path}.{k}", path, k, v) for k, v in _ordered(value)] if family == "object" else [(f"{path}[]", path, None, v) for v in value] if family == "array" else []
        out.append((path, parent, key, family, whole, mask, value if family == "string" else None, len(out)))
        todo.extend(reversed(inner))
    return out


def family_of(value) -> tuple[str, bool | None, int | None]:
    """Kind of a value; of a number whether it is whole, of a string its formats."""
    if isinstance(value, str):
        return "string", None, formats.bits(value)
    if isinstance(value, bool):
        return "boolean", None, None
    if isinstance(value, int):
        return "num", True, None
    if isinstance(value, float):
        return "num", value.is_integer(), None
    if value is None:
        return "null", None, None
    return ("object" if isinstance(value, dict) else "array"), None, None


def observations(bodies: DataFrame) -> DataFrame:
    """A row for each JSON node of ``bodies`` (endpoint, status, ord, body); bodies that don't parse have none."""
    names = [x.split()[0] for x in OBS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in OBS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows: list[tuple] = []
                part = batch.slice(lo, 1000)
                for endpoint, status, ord_, body in zip(*(part.column(c).to_pylist() for c in ("endpoint", "status", "ord", "body")), strict=True):
                    try:
                        found = walk(body) if body is not None else []
                    except ValueError:
                        continue
                    rows += [(endpoint, status, ord_, *f) for f in found]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spread(bodies.select("endpoint", F.col("status").cast("int"), F.col("ord").cast("long"), "body")).mapInArrow(run, OBS)


class _Place:
    """One place of a shape in a batch, with what was seen there by kind of value."""

    __slots__ = ("depth", "held", "inner", "key", "parent", "path", "seen")

    def __init__(self, path: str, parent: str | None, key: str | None, depth: int, held: list[int]):
        self.path, self.parent, self.key, self.depth = path, parent, key, depth
        self.inner: dict[str | None, _Place] = {}
        self.seen: dict[str, list] = {}
        self.held = held  # about how many bytes this place and all that share the list take
        held[0] += PLACE_BYTES + 2 * len(path)

    def child(self, key: str | None) -> _Place:
        found = self.inner.get(key)
        if found is None:
            step = "[]" if key is None else "." + _clean(key).replace(SEP, "\\u001f")
            found = self.inner[key] = _Place(self.path + SEP + step, self.path, None if key is None else step[1:], self.depth + 1, self.held)
        return found

    def alone(self) -> _Place:
        """The place as it is before anything is seen there or below."""
        return _Place(self.path, self.parent, self.key, self.depth, [0])

    def members(self, value: dict | list) -> list[tuple]:
        """Places and values of what lies in an object or array, the last first."""
        if isinstance(value, dict):
            return [(self.child(k), v) for k, v in reversed(_ordered(value))]
        inner = self.child(None) if value else None
        return [(inner, v) for v in reversed(value)]

    def take(self, todo: list[tuple], ord_: int, pos: int = 0) -> int:
        """Adds the nodes of places and values, the last first; the first node's number is ``pos``, the next number is returned."""
        while todo:
            at, value = todo.pop()
            family, whole, mask = family_of(value)
            now = at.seen.get(family)
            if now is None:
                now = at.seen[family] = [0, True, -1, ord_, pos, {} if family == "string" else None]
            now[0] += 1
            if ord_ < now[3]:
                now[3], now[4] = ord_, pos
            if family == "num":
                now[1] = now[1] and whole
            elif family == "string":
                now[2] &= mask
                values = now[5]
                if values is not None:
                    known = values.get(value)
                    if known is not None:
                        known[0] += 1
                        if ord_ < known[1]:
                            known[1:] = ord_, pos
                    elif len(values) <= ENUM_MAX and _TOKEN.fullmatch(value) and not is_numeric_text(value):
                        values[value] = [1, ord_, pos]
                        at.held[0] += VALUE_BYTES
                    else:
                        now[5] = None
            elif family in ("object", "array"):
                todo.extend(at.members(value))
            pos += 1
        return pos

    def refuse(self, ord_: int) -> None:
        """Counts a body that isn't read."""
        now = self.seen.setdefault(REFUSED, [0, True, -1, ord_, 0, None])
        now[0] += 1
        now[3] = min(now[3], ord_)

    def rows(self) -> Iterator[tuple]:
        todo = [self]
        while todo:
            at = todo.pop()
            for family, (n, whole, mask, ord_, pos, values) in at.seen.items():
                listed = [{"v": v, "n": k, "ord": o, "pos": p} for v, (k, o, p) in values.items()] if values is not None else None
                yield at.path, at.parent, at.key, at.depth, family, n, whole if family == "num" else None, mask if family == "string" else None, ord_, pos, listed, family == "string" and values is None
            todo.extend(at.inner.values())


class _Long:
    """An object or array that is longer than a piece.

    ``starts`` has where each member of an object begins, or some members of an array do, and where the last one ends;
    ``inner`` has the members that are longer than a piece; ``order`` how an object's members follow each other, if not as they are written.
    """

    __slots__ = ("inner", "keyed", "order", "starts")

    def __init__(self, keyed: bool, starts: array, inner: dict[int, _Long], order: np.ndarray | None):
        self.keyed, self.starts, self.inner, self.order = keyed, starts, inner, order


class _Body:
    """A body that is too long to be held as values: read once to see that it is JSON and where its parts begin, and then piece by piece."""

    def __init__(self, text: str):
        self.text, self.at, self.window = text, 0, ""
        stop, self.root = self._inner(self._skip(0))
        if self._skip(stop) != len(text):
            raise ValueError("data after JSON")
        self.window = ""

    def _skip(self, at: int) -> int:
        return _white(self.text, at).end()

    def _mark(self, at: int, *allowed: str) -> str:
        found = self.text[at : at + 1]
        if found not in allowed:
            raise ValueError(f"no JSON at {at}")
        return found

    def _key(self, at: int) -> tuple[str, int]:
        """The key at ``at``, and where its value begins."""
        self._mark(at, '"')
        key, at = scanstring(self.text, at + 1)
        at = self._skip(at)
        self._mark(at, ":")
        return key, self._skip(at + 1)

    def _value(self, at: int) -> tuple[int, _Long | None]:
        """Where the value at ``at`` ends, and what is in it if it is an object or array longer than a piece.

        Values are parsed in a window of the text, which moves to a value that doesn't end in it (a number may go on where the window ends, or seem to end before its last . or e there).
        """
        while True:
            try:
                stop = _scan(self.window, at - self.at)[1]
                if self.window[stop : stop + 1] not in ("", ".", "e", "E"):
                    return self.at + stop, None
            except (StopIteration, ValueError):
                pass
            if self.at == at and self.window:
                break
            self.at, self.window = at, self.text[at : at + PIECE]
            if not self.window:
                raise ValueError("JSON ends early")
        if self.window[0] in "{[":
            if at + PIECE >= len(self.text):
                raise ValueError(f"no JSON at {at}")
            return self._inner(at)
        try:
            return _scan(self.text, at)[1], None
        except StopIteration:
            raise ValueError(f"no JSON at {at}") from None

    def _inner(self, at: int) -> tuple[int, _Long]:
        keyed = self._mark(at, "{", "[") == "{"
        close = "}" if keyed else "]"
        starts, inner, hashes, index = array("q"), {}, array("q"), None
        at, apart = self._skip(at + 1), True
        if self.text[at : at + 1] == close:
            return at + 1, _Long(keyed, array("q", [at]), inner, None)
        while True:
            start = at
            if keyed:
                key, at = self._key(at)
                if _is_index(key):
                    index = index or array("q", [-1]) * len(hashes)
                    index.append(int(key))
                elif index is not None:
                    index.append(-1)
                hashes.append(hash(key))
            if keyed or apart or start - starts[-1] >= PIECE:
                starts.append(start)
            stop, found = self._value(at)
            apart = found is not None
            if apart:
                if starts[-1] != start:
                    starts.append(start)
                inner[len(starts) - 1] = found
            at = self._skip(stop)
            if self._mark(at, ",", close) == close:
                break
            at = self._skip(at + 1)
        starts.append(at)
        return at + 1, _Long(keyed, starts, inner, self._order(starts, hashes, index) if keyed else None)

    def _order(self, starts: array, hashes: array, index: array | None) -> np.ndarray | None:
        """Members as ``_ordered`` has them: of equal keys the last value in the first one's place; None if that is as they are written."""
        found = np.frombuffer(hashes, np.int64)
        by_hash = np.sort(found)
        twice = np.unique(by_hash[1:][by_hash[1:] == by_hash[:-1]])
        if index is None and not len(twice):
            return None
        place, stays, last = np.arange(len(found)), np.ones(len(found), bool), {}
        for i in np.flatnonzero(np.isin(found, twice)).tolist():
            key = self._key(starts[i])[0]
            if key in last:
                place[i], stays[last[key]] = place[last[key]], False
            last[key] = i
        rank = place + 2**32
        if index is not None:
            number = np.frombuffer(index, np.int64)
            rank = np.where(number >= 0, number, rank)
        rest = np.flatnonzero(stays)
        return rest[np.argsort(rank[rest], kind="stable")]

    def _pieces(self, of: _Long) -> Iterator[dict | list | tuple[str | None, _Long]]:
        """An object's or array's members, some at a time; one that is longer than a piece with its key."""
        starts, ends = of.starts, len(of.starts) - 1
        if of.order is None:
            i, apart = 0, [*of.inner, ends]
            for stop in apart:
                while i < stop:
                    j = min(max(bisect_right(starts, starts[i] + PIECE) - 1, i + 1), stop)
                    text = self.text[starts[i] : starts[j]]
                    if j < ends:
                        text = text[: text.rindex(",")]
                    yield _parse("{" + text + "}" if of.keyed else "[" + text + "]")
                    i = j
                if stop < ends:
                    yield self._key(starts[i])[0] if of.keyed else None, of.inner[i]
                    i += 1
            return
        some, size = {}, 0
        for lo in range(0, len(of.order), 1000):
            for i in of.order[lo : lo + 1000].tolist():
                key, at = self._key(starts[i])
                if i in of.inner:
                    yield some
                    yield key, of.inner[i]
                    some, size = {}, 0
                    continue
                some[key] = _scan(self.text, at)[0]
                size += starts[i + 1] - starts[i]
                if size > PIECE:
                    yield some
                    some, size = {}, 0
        yield some

    def places(self, ord_: int) -> Iterator[_Place]:
        """Trees of about ``HELD`` bytes that have all the body's nodes between them."""
        pos = 0

        def inside(at: _Place, of: _Long) -> Iterator[_Place]:
            nonlocal pos
            pos = at.take([(at, {} if of.keyed else [])], ord_, pos)
            for piece in self._pieces(of):
                if isinstance(piece, tuple):
                    child = at.child(piece[0]).alone()
                    yield at
                    at = at.alone()
                    yield from inside(child, piece[1])
                    continue
                pos = at.take(at.members(piece), ord_, pos)
                if at.held[0] > HELD:
                    yield at
                    at = at.alone()
            yield at

        return inside(_Place("", None, None, 0, [0]), self.root)


def _opened(text: str):
    """A JSON text's value, as ``parse`` gives it, or a ``_Body`` of an object or array that is long."""
    if len(text) <= LONG or text[_white(text).end() :][:1] not in ("{", "["):
        return parse(text)
    if nesting(text) > MAX_DEPTH:
        raise TooDeep(f"nested deeper than {MAX_DEPTH} levels")
    return _Body(text)


_VALUE = pa.struct([("v", pa.string()), ("n", pa.int64()), ("ord", pa.int64()), ("pos", pa.int32())])
_PARTS = pa.schema(
    [
        ("endpoint", pa.string()), ("slot", pa.string()), ("status", pa.int32()), ("path", pa.string()), ("parent", pa.string()), ("key", pa.string()), ("depth", pa.int32()), ("family", pa.string()),
        ("n", pa.int64()), ("all_int", pa.bool_()), ("fmt_mask", pa.int32()), ("first_ord", pa.int64()), ("first_pos", pa.int32()), ("vals", pa.list_(_VALUE)), ("open", pa.bool_()),
    ]
)


def _sent(roots: dict[tuple, _Place]) -> pa.RecordBatch:
    """All places of trees, by (endpoint, slot, status), as rows of ``PARTS``."""
    rows = [(*key, *row) for key, root in roots.items() for row in root.rows()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)


def walked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS`` of batches of (endpoint, slot, status, ord, body); what is held is bounded, but for one body's text."""
    for batch in batches:
        roots: dict[tuple, _Place] = {}
        held = [0]
        step = max(1, min(1000, batch.num_rows * READ // max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            for endpoint, slot, status, ord_, body in zip(*(part.column(c).to_pylist() for c in ("endpoint", "slot", "status", "ord", "body")), strict=True):
                if body is None:
                    continue
                try:
                    found = _opened(body)
                except TooDeep:
                    found = _DEEP
                except ValueError:
                    continue
                if isinstance(found, _Body):
                    for tree in found.places(ord_):
                        yield _sent({(endpoint, slot, status): tree})
                    found = body = None  # else it stays while the next one is read
                    continue
                root = roots.get((endpoint, slot, status))
                if root is None:
                    root = roots[endpoint, slot, status] = _Place("", None, None, 0, held)
                if found is _DEEP:
                    root.refuse(ord_)
                else:
                    root.take([(root, found)], ord_)
                if held[0] > HELD:
                    yield _sent(roots)
                    roots, held = {}, [0]
        yield _sent(roots)


def walked(bodies: DataFrame) -> DataFrame:
    """Partly aggregated places of ``bodies`` (endpoint, status, ord, body, and slot where not all are responses)."""
    slot = F.col("slot") if "slot" in bodies.columns else F.lit(SLOTS[0])
    status = F.coalesce(F.col("status").cast("int"), F.lit(-1))
    return spread(bodies.select("endpoint", slot.alias("slot"), status.alias("status"), F.col("ord").cast("long"), "body")).mapInArrow(walked_batches, PARTS)


def observe(bodies: DataFrame) -> DataFrame:
    """``walked``, written once: all that is asked of shapes is computed from this small table."""
    return kept(walked(bodies))


def shown(path: Column) -> Column:
    """A place as a path from ``$``."""
    return F.concat(F.lit("$"), F.replace(path, F.lit(SEP), F.lit("")))


def places(parts: DataFrame) -> DataFrame:
    """A row for each (shape, place, kind of value), with ``first``, when it was first seen."""
    on = [*SHAPE, "path", "parent", "key", "depth", "family"]
    seen = F.min(F.struct(F.col("first_ord").alias("ord"), F.col("first_pos").alias("pos")))
    return parts.where(F.col("family") != REFUSED).groupBy(*on).agg(F.sum("n").alias("samples"), F.bool_and("all_int").alias("all_int"), F.bit_and("fmt_mask").alias("fmt_mask"), seen.alias("first"))


def refused(parts: DataFrame) -> DataFrame:
    """(endpoint, slot, status, n) of bodies that were refused for their depth."""
    return parts.where(F.col("family") == REFUSED).groupBy(*SHAPE).agg(F.sum("n").alias("n"))


def nodes(parts: DataFrame) -> DataFrame:
    """A row for each (endpoint, status, path, family) of responses."""
    found = places(parts.where("slot = 'response'"))
    return found.select("endpoint", "status", shown(F.col("path")).alias("path"), "family", "samples", "all_int", "fmt_mask", F.col("first.ord").alias("first_ord"), F.col("first.pos").alias("first_pos"))


def fields(parts: DataFrame) -> DataFrame:
    """A row for each object field of responses: seen, its object's samples, and whether it is optional."""
    parts = parts.where("slot = 'response'")
    seen = parts.where("key is not null").groupBy("endpoint", "status", "parent", "key").agg(F.sum("n").alias("seen"))
    objects = parts.where("family = 'object'").groupBy("endpoint", "status", F.col("path").alias("parent")).agg(F.sum("n").alias("samples"))
    joined = seen.join(objects, ["endpoint", "status", "parent"]).withColumn("optional", F.col("seen") < F.col("samples"))
    return joined.withColumn("parent", shown(F.col("parent")))


def unions(parts: DataFrame) -> DataFrame:
    """Paths with their families; null among them means nullable."""
    n = nodes(parts)
    return n.groupBy("endpoint", "status", "path").agg(F.array_join(F.sort_array(F.collect_set("family")), "|").alias("families"), F.count(F.lit(1)).alias("k"), F.bool_or(F.col("family") == "null").alias("nullable"))


def ancestors(path: Column) -> Column:
    """A place and all that are above it."""
    steps = F.split(path, SEP)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), SEP))


def vocabularies(parts: DataFrame, variants: DataFrame, most: int = ENUM_MAX, least: int = ENUM_MIN) -> DataFrame:
    """String places that are closed vocabularies: samples and ``values`` in order of first sight.

    ``parts`` holds values under the places' final names; ``variants`` (a row for each place and kind) says where unions
    are, at or below which there are no vocabularies.  Distinct values are counted first, and only places with
    at most ``most`` of them list any.
    """
    on = [*SHAPE, "path"]
    strings = parts.where("family = 'string'")
    values = strings.where("not open").select(*on, F.explode("vals").alias("x")).groupBy(*on, F.col("x.v").alias("v")).agg(F.sum("x.n").alias("n"), F.min(F.struct("x.ord", "x.pos")).alias("first"))
    closed = strings.groupBy(*on).agg(F.bool_or("open").alias("open")).where("not open").drop("open")
    fit = values.groupBy(*on).agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("k"))
    fit = fit.where((F.col("samples") >= least) & (F.col("k") <= most) & (F.col("k") <= F.ceil(F.col("samples") / 2))).drop("k")
    plain = variants.where("family = 'string' and fmt_mask = 0").select(*on)
    fit = fit.join(closed, on, "left_semi").join(plain, on, "left_semi")
    unions = variants.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*SHAPE, F.col("path").alias("above"))
    barred = fit.select(*on, F.explode(ancestors(F.col("path"))).alias("above")).join(unions, [*SHAPE, "above"], "left_semi").select(*on).distinct()
    listed = values.join(fit.join(barred, on, "left_anti"), on)
    return listed.groupBy(*on, "samples").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]).alias("values"))


def enums(parts: DataFrame, most: int = ENUM_MAX, least: int = ENUM_MIN) -> DataFrame:
    """``vocabularies`` of responses as they are before dictionaries are collapsed, values joined by commas."""
    found = vocabularies(parts.where("slot = 'response'"), places(parts.where("slot = 'response'")), most, least)
    return found.select("endpoint", "status", shown(F.col("path")).alias("path"), "samples", F.array_join("values", ",").alias("values"))


def records(parts: DataFrame, least: int = RECORD_KEYS) -> DataFrame:
    """Objects of responses that are dictionaries: at least ``least`` keys, all with equal shapes."""
    from .model import dictionaries

    found = dictionaries(places(parts.where("slot = 'response'")), least)
    return found.select("endpoint", "status", shown(F.col("path")).alias("path"), F.col("n_keys").alias("keys"))


def first_seen_order(parts: DataFrame) -> DataFrame:
    """Fields of each object of responses numbered in order of first sight."""
    keyed = parts.where("key is not null and slot = 'response'")
    f = keyed.groupBy("endpoint", "status", "parent", "key").agg(F.min(F.struct("first_ord", "first_pos")).alias("first"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("endpoint", "status", "parent").orderBy("first"))).drop("first").withColumn("parent", shown(F.col("parent")))
