"""The append log of a recording, and a Spark data source that reads and writes it.

``<recording>/data/<attempt>/`` has the files that tasks write, one line for each exchange.  ``<recording>/log/<number>.json`` has one entry for each
committed append: its batch, its place in the recording, and for each file its lines and bytes, with marks of (byte, line) about every
``MARK`` bytes.  An entry appears whole, under the next free number, or not at all, so appends that run side by side take turns without
losing any; files without an entry belong to no reader.  A batch that has an entry is not added again.

As entries carry counts and marks, a reader plans its splits and every line's gapless ``ord`` from the entries alone and reads the data once;
a recording's count is the end of its last entry.

Files are reached through ``pyarrow.fs`` (local, S3, GCS, HDFS).  The commit needs a file system that doesn't replace a file by another's name: a link does that
locally, a rename on HDFS.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

MARK = 4 << 20
FORMAT = "tidemark_recording"
LINES = "ord long, text string"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:", "") if folder.startswith("file:") else folder)
    return pafs.LocalFileSystem(), os.path.abspath(folder)


class Log:
    """Entries of one recording."""

    def __init__(self, folder: str):
        self.fs, self.root = opened(folder.rstrip("/"))
        self._known: list[dict] = []

    def entries(self) -> list[dict]:
        """All entries in order; those read before are not read again."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = sorted(i.path for i in found if i.base_name.endswith(".json"))
        for path in names[len(self._known) :]:
            with self.fs.open_input_stream(path) as stream:
                self._known.append(json.loads(stream.read()))
        return self._known

    def count(self) -> int:
        last = self.entries()[-1:]
        return last[0]["start"] + last[0]["count"] if last else 0

    def updated(self) -> int:
        return max((e["at"] for e in self.entries()[-1:]), default=0)

    def has(self, batch: str) -> bool:
        return any(e["batch"] == batch for e in self.entries())

    def commit(self, batch: str, files: list[dict]) -> bool:
        """Adds an entry of ``files`` under the next free number; false if the batch has one already."""
        while True:
            entries = self.entries()
            if any(e["batch"] == batch for e in entries):
                return False
            entry = {"seq": len(entries), "batch": batch, "at": int(time.time() * 1000), "start": self.count(), "count": sum(f["lines"] for f in files), "files": files}
            if self._put(f"{self.root}/log/{len(entries):020d}.json", json.dumps(entry).encode()):
                return True

    def _put(self, path: str, content: bytes) -> bool:
        """Makes a file with this content appear at once; false if there is one."""
        self.fs.create_dir(path.rpartition("/")[0])
        own = f"{self.root}/log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as stream:
            stream.write(content)
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(own, path)
                return True
            if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                return False
            self.fs.move(own, path)
            return True
        except FileExistsError:
            return False
        except OSError:
            if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
                raise
            return False
        finally:
            if self.fs.get_file_info(own).type != pafs.FileType.NotFound:
                self.fs.delete_file(own)

    def vacuum(self) -> list[str]:
        """Deletes attempts that no entry names; for times without appends."""
        used = {f["path"].split("/")[1] for e in self.entries() for f in e["files"]}
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/data", allow_not_found=True))
        gone = [i.base_name for i in found if i.type == pafs.FileType.Directory and i.base_name not in used]
        for name in gone:
            self.fs.delete_dir(f"{self.root}/data/{name}")
        return gone


@dataclass
class Split(InputPartition):
    """Bytes of a file that begin and end with lines, and the first line's place in the recording."""

    path: str
    start: int
    end: int
    ord: int


def splits(entries: list[dict]) -> list[Split]:
    out = []
    for entry in entries:
        ord_ = entry["start"]
        for f in entry["files"]:
            marks = [(0, 0), *map(tuple, f["marks"]), (f["bytes"], f["lines"])]
            out += [Split(f["path"], a, b, ord_ + line) for (a, line), (b, _) in zip(marks, marks[1:]) if b > a]
            ord_ += f["lines"]
    return out


def _read(folder: str, split: Split) -> Iterator[pa.RecordBatch]:
    files, root = opened(folder)
    with files.open_input_file(f"{root}/{split.path}") as source:
        source.seek(split.start)
        left, rest, ord_ = split.end - split.start, b"", split.ord
        while left > 0:
            data = rest + source.read(min(left, 1 << 20))
            left = split.end - source.tell()
            lines = data.split(b"\n")
            rest = lines.pop()
            if lines:
                texts = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(range(ord_, ord_ + len(lines)), pa.int64()), texts], ["ord", "text"])
                ord_ += len(lines)


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return splits(Log(self.folder).entries()) or [Split("", 0, 0, 0)]

    def read(self, partition: Split):
        if partition.end > partition.start:
            yield from _read(self.folder, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are numbers of entries, which only grow."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(Log(self.folder).entries())}

    def partitions(self, start: dict, end: dict):
        return splits(Log(self.folder).entries()[start["entries"] : end["entries"]])

    def read(self, partition: Split):
        yield from _read(self.folder, partition)


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: dict | None


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its own; the entry that names them all is committed when every task is done."""

    def __init__(self, folder: str, batch: str):
        self.folder, self.batch, self.attempt = folder, batch, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        files, root = opened(self.folder)
        path, stream = f"data/{self.attempt}/part-{task:05d}-{uuid.uuid4().hex}.ndjson", None
        lines = size = 0
        marks: list[tuple[int, int]] = []
        for batch in iterator:
            for text in batch.column("text").to_pylist():
                raw = (text or "").replace("\n", " ").encode() + b"\n"
                if stream is None:
                    files.create_dir(f"{root}/data/{self.attempt}")
                    stream = files.open_output_stream(f"{root}/{path}")
                if size - (marks[-1][0] if marks else 0) >= MARK:
                    marks.append((size, lines))
                stream.write(raw)
                lines, size = lines + 1, size + len(raw)
        if stream is None:
            return Written(task, None)
        stream.close()
        return Written(task, {"path": path, "lines": lines, "bytes": size, "marks": marks})

    def commit(self, messages) -> None:
        written = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.task)
        if not Log(self.folder).commit(self.batch, [m.file for m in written]):
            self.abort(messages)

    def abort(self, messages) -> None:
        files, root = opened(self.folder)
        if files.get_file_info(f"{root}/data/{self.attempt}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/data/{self.attempt}")


class Recording(DataSource):
    """Lines of a recording: ``spark.read``, ``readStream`` and ``write`` with this format; options ``path`` and, to write, ``batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("A recording is only appended to.")
        return Writer(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)


def _registered(spark: SparkSession) -> SparkSession:
    """The session with the format; it is made this thread's own, since Spark looks formats up there."""
    spark.dataSource.register(Recording)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    return spark


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, text) of a recording's log."""
    return _registered(spark).read.format(FORMAT).option("path", folder).load()


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, text) of a recording's log as it grows; ``ord`` is that of the whole recording."""
    return _registered(spark).readStream.format(FORMAT).option("path", folder).load()


def append(ordered: DataFrame, folder: str, batch: str) -> None:
    """Adds the column ``text`` of ``ordered``, in the order of its partitions and rows."""
    _registered(ordered.sparkSession)
    ordered.select("text").write.format(FORMAT).mode("append").option("path", folder).option("batch", batch).save()
