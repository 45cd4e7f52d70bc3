"""A sink for files with names of their own: each row (path, content) becomes a file under a folder, written by the task that has the row.

Tasks write under ``<folder>/.<attempt>``; when all are done the files are put in place, and a failed write leaves nothing.  Contents don't pass
through the driver.  A path that leaves the folder is refused, and so are two rows with one path.  Files that were there under other names stay.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .log import opened

FORMAT = "tidemark_files"


def checked(path: str) -> str:
    """A relative path inside the folder, in its plain form."""
    plain = posixpath.normpath(path or "")
    if plain.startswith(("/", "../")) or plain in ("..", ".") or "\\" in plain or "\x00" in plain:
        raise ValueError(f"no path inside the folder: {path!r}")
    return plain


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.attempt = folder, f".{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, root = opened(self.folder)
        own = f"{self.attempt}/{TaskContext.get().taskAttemptId()}"  # a task that runs twice writes twice; one is named in the end
        paths = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = f"{own}/{checked(path)}"
                if place in paths:
                    raise ValueError(f"two files of one path: {path!r}")
                files.create_dir(f"{root}/{place}".rpartition("/")[0])
                with files.open_output_stream(f"{root}/{place}") as stream:
                    stream.write((content or "").encode())
                paths.append(place)
        return Written(paths)

    def commit(self, messages) -> None:
        files, root = opened(self.folder)
        found = [p for m in messages if m is not None for p in m.paths]
        place = {p: p.split("/", 2)[2] for p in found}
        if len(set(place.values())) < len(place):
            self.abort(messages)
            raise ValueError("two files of one path")
        for path, target in place.items():
            files.create_dir(f"{root}/{target}".rpartition("/")[0])
            files.move(f"{root}/{path}", f"{root}/{target}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, root = opened(self.folder)
        if files.get_file_info(f"{root}/{self.attempt}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.attempt}")


class Files(DataSource):
    """``df.write.format("tidemark_files").mode("append").option("path", folder).save()`` for (path, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write(found: DataFrame, folder: str) -> list[str]:
    """Writes (path, content) rows as files under ``folder``; returns the paths."""
    spark = found.sparkSession
    spark.dataSource.register(Files)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    found.select("path", "content").write.format(FORMAT).mode("append").option("path", folder).save()
    return [f"{folder.rstrip('/')}/{checked(r['path'])}" for r in found.select("path").toLocalIterator()]
