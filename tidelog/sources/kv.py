"""``spark.read.format("tidelog")``: a store's visible rows, history or log as a data source.

The reader plans one partition for each Parquet file of the segments that the key range leaves, and tasks read
files with pyarrow through the path's file system.  Versions are resolved afterwards by ``read``, in Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.operators import resolve
from tidelog.plans import manifest
from tidelog.plans.scratch import importable
from tidelog.plans.store import Store


def read(spark: SparkSession, path: str, mode: str = "visible", as_of: int | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """mode: visible (newest puts), history (all versions, ranked) or log (rows as written)."""
    store = Store.open(spark, path)
    rows = store.log(low, high)
    if mode == "log":
        return resolve.snapshot(rows, as_of)
    if mode == "history":
        return resolve.history(resolve.snapshot(rows, as_of))
    return resolve.visible(rows, as_of, store.state["live_seq"]).select("user_key", "value", "seq")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, low: str | None, high: str | None):
        self.path, self.low, self.high = path, low, high

    def partitions(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        names = manifest.states([f.path for f in files.get_file_info(fs.FileSelector(f"{root}/manifest"))])
        with files.open_input_stream(names[-1]) as stream:
            state = json.loads(stream.read())
        out = []
        for s in state["segments"]:
            if (self.high is None or s["min_key"] <= self.high) and (self.low is None or s["max_key"] >= self.low):
                out += [_File(f.path) for f in files.get_file_info(fs.FileSelector(f"{root}/{s['path']}")) if f.path.endswith(".parquet")]
        return out

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        yield from pq.ParquetFile(files.open_input_file(partition.path)).iter_batches(columns=["user_key", "seq", "kind", "value"])


class StoreSource(DataSource):
    """Options: path, low and high (keys in upper-case hex).  Gives the log; resolve it with ``operators.resolve``."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return "user_key binary, seq long, kind byte, value binary"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("low"), self.options.get("high"))


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(StoreSource)
