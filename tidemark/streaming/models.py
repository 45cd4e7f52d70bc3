"""A model kept up to date by a stream: every batch's state is merged into that of all batches before it.

A folder has one version of the state for each batch, ``v=<number>``, complete once its ``done`` file is there.  A repeated batch starts
from the version before it and replaces its own, so after a failure nothing counts twice.  The last ``KEEP`` versions stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import model, state
from ..sources.exchanges import with_endpoint

KEEP = 2
LANDED = "ord long, method string, path string, url string, status int, content_type string, body string, req_body string"


class ModelFolder:
    """Versions of a state under one folder, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        fs, path = self._at()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(v for n in names if n.startswith("v=") and fs.exists(self._at(n, "done")[1]) for v in [int(n[2:])])

    def state(self, before: int | None = None) -> state.State | None:
        """The state of the last complete version, or of the last below ``before``."""
        found = [v for v in self.versions() if before is None or v < before]
        return state.read(self.spark, f"{self.folder}/v={found[-1]}") if found else None

    def add(self, exchanges: DataFrame, number: int) -> None:
        """Merges batch ``number``, exchanges with endpoint and params, into the versions before it."""
        fs, own = self._at(f"v={number}")
        fs.delete(own, True)
        before = self.state(number)
        now = state.gathered(exchanges)
        state.write(state.merged([now] if before is None else [before, now]), f"{self.folder}/v={number}")
        fs.create(self._at(f"v={number}", "done")[1], True).close()
        for old in [v for v in self.versions() if v <= number][:-KEEP]:
            fs.delete(self._at(f"v={old}")[1], True)

    def model(self, name: str = "recording", target: str = "", options: model.Options = model.Options()) -> model.Model:
        found = self.state()
        if found is None:
            raise FileNotFoundError(f"No state in {self.folder}")
        return model.of_state(found, name, target, options)


def keep_model(stream: DataFrame, folder: str, checkpoint: str, force: tuple[str, ...] = ()) -> StreamingQuery:
    """Merges every batch of ``stream`` (``LANDED`` columns) into the state in ``folder`` until what has landed is read."""
    kept = ModelFolder(stream.sparkSession, folder)

    def batch(df: DataFrame, number: int) -> None:
        own = df.persist()
        try:
            kept.add(with_endpoint(own, force), number)
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of landed exchanges, Parquet files of the ``LANDED`` columns."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
