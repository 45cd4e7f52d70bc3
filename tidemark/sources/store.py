"""A store of recordings: a folder for each, with a log of exchanges (see ``log``) and a file of metadata.

Tasks read and write the logs; the metadata is one small file a recording.  A folder
with a plain ``exchanges.ndjson`` that something else has recorded is a recording too; its first append takes that file into the log.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import formats
from ..functions import scalars as S
from ..operators import claims
from ..operators import model as M
from . import log
from .exchanges import with_endpoint

_PLAIN = "exchanges.ndjson"
_IGNORE = "# recordings hold real captured payloads.\n*\n"
EXCHANGE = (
    "id string, started_at long, method string, url string, path string, query map<string,array<string>>, req_headers map<string,string>, req_text string, req_json string, "
    "status int, res_headers map<string,string>, res_text string, res_json string, duration_ms long"
)
META = "name string, target string, createdAt long, updatedAt long, exchangeCount long"


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("line"), f"$.{path}", kind)


def exchanges_of(lines: DataFrame) -> DataFrame:
    """Exchanges of log lines (text, ord): blanks of any kind are trimmed, blank and corrupt lines skipped."""
    blank = f"^[{formats.WHITE}]+|[{formats.WHITE}]+$"
    d = lines.withColumn("text", F.regexp_replace("text", blank, "")).where("text <> ''").withColumn("line", F.try_parse_json("text")).where("line is not null")
    body = lambda p: F.when(F.try_variant_get("line", F.lit(f"$.{p}"), "variant").isNotNull(), F.to_json(F.try_variant_get("line", F.lit(f"$.{p}"), "variant")))
    return d.select(
        "ord", _field("id").alias("id"), _field("startedAt", "long").alias("started_at"), _field("request.method").alias("method"), _field("request.url").alias("url"), _field("request.path").alias("path"),
        _field("request.query", "map<string,array<string>>").alias("query"), _field("request.headers", "map<string,string>").alias("req_headers"), _field("request.bodyText").alias("req_text"), body("request.bodyJson").alias("req_json"),
        _field("response.status", "int").alias("status"), _field("response.headers", "map<string,string>").alias("res_headers"), _field("response.bodyText").alias("res_text"), body("response.bodyJson").alias("res_json"),
        _field("response.durationMs", "long").alias("duration_ms"),
    )


class Store:
    """Recordings under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._root = log.opened(self.folder)

    def _has(self, *parts: str) -> bool:
        return self._fs.get_file_info("/".join((self._root, *parts))).type != pafs.FileType.NotFound

    def _write(self, text: str, *parts: str, replace: bool = True) -> None:
        """Puts a file in place at once, so that no reader sees a part of it."""
        if not replace and self._has(*parts):
            return
        path = "/".join((self._root, *parts))
        self._fs.create_dir(path.rpartition("/")[0])
        own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(own) as stream:
            stream.write(text.encode())
        self._fs.move(own, path)

    def _text(self, *parts: str) -> str | None:
        try:
            with self._fs.open_input_stream("/".join((self._root, *parts))) as stream:
                return stream.read().decode()
        except FileNotFoundError:
            return None

    def log(self, name: str) -> log.Log:
        return log.Log(f"{self.folder}/{name}")

    def meta(self, name: str) -> dict | None:
        """A recording's metadata; count and time are those of its log, where it has one."""
        text = self._text(name, "meta.json")
        if text is None:
            return None
        meta = json.loads(text)
        own = self.log(name)
        if isinstance(meta, dict) and own.entries():
            meta |= {"exchangeCount": own.count(), "updatedAt": max(meta.get("updatedAt") or 0, own.updated())}
        return meta

    def init(self, name: str, target: str) -> dict:
        """Creates a recording, or opens one: that keeps its exchanges, createdAt and count."""
        self._write(_IGNORE, ".gitignore", replace=False)
        now = int(time.time() * 1000)
        meta = (self.meta(name) or {"name": name, "target": target, "createdAt": now, "updatedAt": now, "exchangeCount": 0}) | {"target": target, "updatedAt": now}
        self._write(json.dumps(meta, indent=2), name, "meta.json")
        return meta

    def append(self, name: str, exchanges: DataFrame, batch: str | None = None) -> dict:
        """Appends exchanges (``EXCHANGE`` and ord) whole or not at all; a ``batch`` that is there already adds nothing.

        Appends may run side by side.  What is written is counted as it is written; the log isn't read.
        """
        if self.meta(name) is None:
            self.init(name, "")
        own = self.log(name)
        if not own.entries() and self._has(name, _PLAIN):
            log.append(self.lines(name).repartitionByRange("ord").sortWithinPartitions("ord"), f"{self.folder}/{name}", _PLAIN)
        if batch is not None and own.has(batch):
            return self.meta(name)
        request = F.struct("method", "url", "path", F.coalesce("query", F.create_map()).alias("query"), F.coalesce("req_headers", F.create_map()).alias("headers"))
        parts = [F.to_json(F.struct("id", F.col("started_at").alias("startedAt"))), F.to_json(request), F.to_json(F.struct("status", F.coalesce("res_headers", F.create_map()).alias("headers"), F.col("duration_ms").alias("durationMs")))]

        def with_body(text: Column, body_text: str, body_json: str) -> Column:
            inner = F.substring(text, F.lit(1), F.length(text) - 1)
            has_text = F.when(F.col(body_text).isNotNull(), F.concat(F.lit(',"bodyText":'), S._json_string(F.col(body_text)))).otherwise("")
            return F.concat(inner, has_text, F.when(F.col(body_json).isNotNull(), F.concat(F.lit(',"bodyJson":'), body_json)).otherwise(""), F.lit("}"))

        head = F.substring(parts[0], F.lit(1), F.length(parts[0]) - 1)
        line = F.concat(head, F.lit(',"request":'), with_body(parts[1], "req_text", "req_json"), F.lit(',"response":'), with_body(parts[2], "res_text", "res_json"), F.lit("}"))
        ordered = exchanges.select("ord", line.alias("text")).repartitionByRange("ord").sortWithinPartitions("ord")
        log.append(ordered, f"{self.folder}/{name}", batch or f"{time.time_ns():020d}-{uuid.uuid4().hex}")
        return self.meta(name)

    def lines(self, name: str) -> DataFrame:
        """(text, ord) of a recording, ``ord`` being gapless."""
        if self.log(name).entries():
            return log.lines(self.spark, f"{self.folder}/{name}")
        if not self._has(name, _PLAIN):
            return self.spark.createDataFrame([], log.LINES)
        return read_lines(self.spark, f"{self.folder}/{name}/{_PLAIN}")

    def stream(self, name: str) -> DataFrame:
        """A recording's exchanges as a stream of what is appended."""
        return exchanges_of(log.line_stream(self.spark, f"{self.folder}/{name}"))

    def load(self, name: str) -> DataFrame:
        """A recording's exchanges; an error where there is no recording."""
        if self.meta(name) is None:
            raise FileNotFoundError(f"Recording not found: {name}")
        return exchanges_of(self.lines(name))

    def list(self) -> DataFrame:
        """Metadata of all recordings, the last updated first; folders without metadata are no recordings."""
        inside = self._fs.get_file_info(pafs.FileSelector(self._root, allow_not_found=True))
        folders = [i.base_name for i in inside if i.type == pafs.FileType.Directory]
        found = [m for f in folders if (m := self._try_meta(f)) is not None]
        rows = [(m.get("name"), m.get("target"), m.get("createdAt"), m.get("updatedAt"), m.get("exchangeCount")) for m in found]
        return self.spark.createDataFrame(rows, META).orderBy(F.desc("updatedAt"))

    def _try_meta(self, name: str) -> dict | None:
        try:
            found = self.meta(name)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def remove(self, name: str) -> None:
        if self._has(name):
            self._fs.delete_dir(f"{self._root}/{name}")

    def model(self, name: str, options: M.Options = M.Options()) -> M.Model:
        meta = self.meta(name) or {}
        return M.build(for_model(self.load(name), options), meta.get("name", name), meta.get("target", ""), options, meta.get("updatedAt", 0))


def read_lines(spark: SparkSession, source: str) -> DataFrame:
    """(text, ord) of text files.  Lines are ordered by file name, the split's offset in the file and the place in the split, so
    the order doesn't depend on how splits are packed into tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    d = spark.read.text(source, recursiveFileLookup=True).select(F.col("value").alias("text"), place.alias("place"))
    blocks = d.groupBy("place.file", "place.at").agg(F.min("place.k").alias("k0"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("start", before)  # a row for each split of a file
    joined = d.join(F.broadcast(starts) if blocks.count() <= 100_000 else starts, (F.col("place.file") == F.col("file")) & (F.col("place.at") == F.col("at")))
    return joined.select("text", (F.col("start") + F.col("place.k") - F.col("k0")).cast("long").alias("ord"))


def for_model(exchanges: DataFrame, options: M.Options = M.Options()) -> DataFrame:
    """A recording's exchanges as ``model.build`` wants them."""
    d = exchanges.withColumnsRenamed({"res_json": "body", "req_json": "req_body"}).withColumn("content_type", F.try_element_at("res_headers", F.lit("content-type")))
    return with_endpoint(d, options.force)


def capture(raw: DataFrame, cap: int = 1 << 20, redact: tuple[str, ...] = S.REDACTED) -> DataFrame:
    """Exchanges of raw captures (ord, method, url, req_headers, req_body, status, res_headers, res_body, started_at, ended_at):
    methods upper case, headers normalized and redacted, bodies decoded and parsed where they are JSON."""
    d = raw.withColumn("req_headers", S.normalize_headers(F.col("req_headers"), redact)).withColumn("res_headers", S.normalize_headers(F.col("res_headers"), redact))
    of = lambda h: F.try_element_at(h, F.lit("content-type"))
    d = d.withColumn("q", S.decode_body(F.col("req_body"), cap, of("req_headers"))).withColumn("p", S.decode_body(F.col("res_body"), cap, of("res_headers")))
    query = F.map_from_entries(F.transform(S.query_map(F.col("url")), lambda e: F.struct(e["key"], e["values"])))
    return d.select(
        "ord", F.uuid().alias("id"), "started_at", F.upper("method").alias("method"), "url", S.path_only(F.col("url")).alias("path"), query.alias("query"), "req_headers", F.col("q.text").alias("req_text"), F.col("q.json").alias("req_json"),
        F.col("status").cast("int").alias("status"), "res_headers", F.col("p.text").alias("res_text"), F.col("p.json").alias("res_json"), (F.col("ended_at") - F.col("started_at")).alias("duration_ms"),
    )


#: What a body may grow to when it is inflated, unless told otherwise.
INFLATED = 64 << 20
_CODECS = {"gzip": "gzip", "x-gzip": "gzip", "br": "brotli"}


def _inflated(raw: bytes, name: str | None, most: int) -> bytes:
    """The decoded body; ``raw`` where the encoding is another, the bytes aren't of it, or they would grow beyond ``most``."""
    kind = (name or "").strip().lower()
    if kind == "deflate":
        for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            stream = zlib.decompressobj(bits)
            try:
                found = stream.decompress(raw, most + 1)
            except zlib.error:
                continue
            return found if stream.eof and len(found) <= most else raw
        return raw
    if kind not in _CODECS:
        return raw
    try:
        out, size = [], 0
        with pa.CompressedInputStream(pa.BufferReader(raw), _CODECS[kind]) as stream:
            while part := stream.read(min(1 << 16, most + 1 - size)):
                out.append(part)
                size += len(part)
                if size > most:
                    return raw
        return b"".join(out)
    except OSError:
        return raw


def decode_content(body: Column, encoding: Column, most: int = INFLATED) -> Column:
    """Bytes of a gzip, brotli or deflate body, inflated as a stream; others, what can't be decoded, and what
    would take more than ``most`` bytes, as they are."""

    def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _inflated(b, n, most) for b, n in zip(bodies, names, strict=True)], dtype=object)

    return pandas_udf(run, "binary")(body, encoding)


def resolve_side(spark: SparkSession, store: Store, ref: str) -> tuple[M.Model, list[dict]]:
    """The model that ``ref`` names: a model or claims file, else a recording; and what of claims can't be audited."""
    from pathlib import Path

    if Path(ref).is_file():
        return claims.read_model(spark, ref)
    try:
        return store.model(ref), []
    except FileNotFoundError:
        raise ValueError(f'Could not resolve "{ref}": not a readable file and not a recording in {store.folder}.') from None


def resolve_recording(store: Store, name: str | None = None) -> str:
    """The name given, else that of the only recording."""
    if name is not None:
        return name
    names = sorted(r["name"] for r in store.list().select("name").limit(1001).collect())
    if len(names) == 1:
        return names[0]
    raise ValueError(f"{'Multiple' if names else 'No'} recordings in {store.folder}{': ' + ', '.join(names) if names else ''}.")


def diff_sides(a: str | None = None, b: str | None = None, claims: str | None = None, observed: str | None = None) -> tuple[str, str]:
    """The two sides, given by place or by name, not both."""
    if (claims or observed) and (a or b):
        raise ValueError("Give two sides, or claims and observed, not both.")
    pair = (claims, observed) if claims or observed else (a, b)
    if not all(pair):
        raise ValueError("Both sides are needed.")
    return pair
