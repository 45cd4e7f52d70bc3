"""WARC records in ZIP-packaged archives: writing them, and reading records by range.

An archive is a ZIP file whose members are all stored: ``archive/data.warc.gz`` (one
gzip member a record) and ``indexes/index.cdx`` (page_id, offset and length of each
record in the data member).  Records of equal payloads refer to one of them instead of
repeating it.  The reader parses the end record, the ZIP64 locator and end record where
present, and the central directory; a record is then read by its range in the file, and
nothing is extracted.

Files go to the cluster's shared folder through ``pyarrow.fs``.  Each task attempt writes
names of its own, and only the manifest, a table written after the archives, says which
count, so a lost executor or a repeated task leaves at most files that nobody reads.

Defined cases: a null html is an empty payload; null or odd urls are left out or escaped;
rows that share the largest page_id of a payload are all responses; an empty table gives
no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 256 << 20
SLICE_RECORDS = 2000
MIN_REVISIT_BYTES = 1000
MAX_READ_TASKS = 4096
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~-._')}")
    block = _HTTP
    if refers_to is None:
        block += payload or b""
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; the payload of a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x and x != "<urn:page:>" else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload, "payload_digest": digest, "record_type": kind,
        "payload_bytes": int(fields["x-payload-length"]), "refers_to": number(fields.get("warc-refers-to")),
    }


class ArchiveWriter:
    """Streams records into one archive; the index follows the data."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path, self.records, self.size = path, 0, 0
        self._out = fs.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._index: list[str] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self._data.write(packed)
        self._index.append(f"{'' if page_id is None else page_id} {self.size} {len(packed)}\n")
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "".join(self._index))
        self._zip.close()
        self._out.close()


class ArchiveReader:
    """Random access to the stored members of a ZIP file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self._file = fs.open_input_file(path)
        self.members = self._directory()

    def _at(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def _directory(self) -> dict[str, tuple[int, int]]:
        size = self._file.size()
        tail_at = max(0, size - 65557)  # the end record and the longest comment
        tail = self._at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP file")
        entries, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (entries == 0xFFFF or 0xFFFFFFFF in (length, start)):
            (far,) = struct.unpack_from("<Q", tail, end - 12)
            record = self._at(far, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            entries, length, start = struct.unpack_from("<QQQ", record, 32)
        central, at, found = self._at(start, length), 0, {}
        for _ in range(entries):
            if central[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain = struct.unpack_from("<H8xII", central, at + 10)[0], *struct.unpack_from("<II", central, at + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", central, at + 28)
            (header,) = struct.unpack_from("<I", central, at + 42)
            name = central[at + 46 : at + 46 + n_name].decode()
            extra, k = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # ZIP64: only the fields that didn't fit, in this order
                    wide, j = extra[k + 4 : k + 4 + n], 0
                    if plain == 0xFFFFFFFF:
                        plain, j = struct.unpack_from("<Q", wide, j)[0], j + 8
                    if packed == 0xFFFFFFFF:
                        packed, j = struct.unpack_from("<Q", wide, j)[0], j + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", wide, j)[0]
                k += 4 + n
            if method == 0:
                found[name] = (header, packed)
            at += 46 + n_name + n_extra + n_comment
        return found

    def member(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        header, size = self.members[name]
        n_name, n_extra = struct.unpack_from("<HH", self._at(header, 30), 26)
        return header + 30 + n_name + n_extra, size

    def index(self) -> list[tuple[int, int]]:
        at, size = self.member(INDEX)
        return [(int(o), int(n)) for _, o, n in (x.split(" ") for x in self._at(at, size).decode().splitlines())]

    def records(self, first: int, count: int) -> Iterator[tuple[int, int, dict]]:
        """Offset, length and content of a run of the index's records."""
        start, _ = self.member(DATA)
        for offset, length in self.index()[first : first + count]:
            yield offset, length, parse_record(gzip.decompress(self._at(start + offset, length)))

    def close(self) -> None:
        self._file.close()


def classify(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` with payload (of responses only), digest, size and refers_to.

    Only page_id and digest move to find equal payloads; counts are partly aggregated by
    every task, and the join with them is one that Spark can split where a payload is hot.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    thin = written(full.where(F.col("size") >= least).select("page_id", "digest"), "warc-digests")
    equal = written(thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to"), "warc-equal")
    revisits = written(thin.join(equal, "digest").where("page_id < refers_to").distinct(), "warc-revisits")
    joined = full.join(revisits, ["page_id", "digest"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the manifest (archive, records) as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        done, now = [], None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                for r in batch.slice(k, 200).to_pylist():
                    if now is None:
                        now = ArchiveWriter(fs, f"{root}/pages-{uuid.uuid4().hex}.zip")
                    now.add(r["page_id"], _record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["refers_to"]))
                    if now.size >= ARCHIVE_BYTES:
                        now.close()
                        done.append(now)
                        now = None
        if now is not None:
            now.close()
            done.append(now)
        yield pa.RecordBatch.from_arrays([pa.array([a.path.rpartition("/")[2] for a in done], pa.string()), pa.array([a.records for a in done], pa.int64())], ["archive", "records"])

    return written(classified.mapInArrow(run, "archive string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the manifest's archives; tasks read runs of records."""
    slices = manifest.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("records") - 1, F.lit(SLICE_RECORDS)))))
    tasks = min(MAX_READ_TASKS, max(1, slices.count()))
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for archive, slice_ in zip(batch.column("archive").to_pylist(), batch.column("slice").to_pylist(), strict=True):
                reader, rows = ArchiveReader(fs, f"{root}/{archive}"), []
                for offset, length, found in reader.records(slice_ * SLICE_RECORDS, SLICE_RECORDS):
                    if not payloads:
                        del found["payload"]
                    rows.append(found | {"archive": archive, "offset": offset, "length": length})
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return slices.select("archive", "slice").repartition(tasks, "archive", "slice").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(classify(pages), folder), folder, payloads)
