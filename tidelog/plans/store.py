"""A versioned table over immutable Parquet segments."""

from __future__ import annotations

import contextlib
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.functions import bloom
from tidelog.operators import compaction, merge, resolve
from tidelog.plans import manifest
from tidelog.schema import DELETE, LOG, MAX_SEQ, PUT, Options, Status, StoreError

log = logging.getLogger("tidelog")

#: What the manifest says of a segment's rows; the checksum doesn't depend on their order.
_FACTS = ("rows", "min_key", "max_key", "min_seq", "max_seq", "check")


#: Bytes of rows from which on a merge has more tasks than the cluster has cores.
_TASK_BYTES = 64 << 20


def _facts() -> list:
    row = F.xxhash64("user_key", "seq", "kind", "value")
    each = (F.count(F.lit(1)), F.hex(F.min("user_key")), F.hex(F.max("user_key")), F.min("seq"), F.max("seq"), F.bit_xor(row))
    return [c.alias(n) for n, c in zip(_FACTS, each, strict=True)]


class Store:
    """put, get, delete, scan, expire, compact and gc.

    Batches are DataFrames with ``user_key`` and ``value``; single puts and deletes collect in a small driver-side
    table that reads see as one more source and that is written as a segment when it is full.  Each is a small file of
    the log folder before its call returns, from which the table is filled again when the store is opened.  Every write
    gets dense sequence numbers from ``last_seq`` on.  One writer at a time commits; readers keep the manifest they read,
    and the files that it names stay until a gc that comes ``retain_seconds`` later.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.files = manifest.Files(spark, path)
        self.state = manifest.load(self.files)
        if self.state is None:
            self.files.make("manifest")
            self.state = manifest.commit(self.files, manifest.empty())
        self.memory: list[tuple] = []
        self.memory_bytes = 0
        self.last_seq = self.state["last_seq"]
        self._recover()

    def _recover(self) -> None:
        """Take up single operations that were logged and not flushed."""
        for name in manifest.states(self.files.names("log")):
            if manifest.number_of(name) == self.last_seq:
                key, kind, value = json.loads(self.files.read(f"log/{name}"))
                self._hold(bytes.fromhex(key), kind, None if value is None else bytes.fromhex(value))

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        return cls(spark, path, options)

    # ------------------------------------------------------------ writes

    def _fits(self, key: bytes) -> None:
        n = self.options.fixed_key_length
        if 0 < n < 64 and len(key) != n:
            raise StoreError(Status.NOT_FOUND, f"keys have {n} bytes")

    def put(self, key: bytes, value: bytes) -> Status:
        self._fits(key)
        self._remember(bytes(key), PUT, bytes(value))
        return Status.OK

    def delete(self, key: bytes) -> Status:
        """NOT_FOUND, and nothing written, if there is no such key."""
        self._fits(key)
        status, _ = self.get(key)
        if not status.ok:
            return Status.NOT_FOUND
        self._remember(bytes(key), DELETE, None)
        return Status.OK

    def _remember(self, key: bytes, kind: int, value: bytes | None) -> None:
        if self.last_seq > MAX_SEQ:
            raise StoreError(Status.INVALID_ARGUMENT, "sequence numbers are used up")
        if self.options.durable:
            self.files.make("log")
            if not self.files.write(f"log/{self.last_seq:020d}.json", json.dumps([key.hex(), kind, None if value is None else value.hex()])):
                raise StoreError(Status.IO_ERROR, "another writer has logged this number")
        self._hold(key, kind, value)
        if self.memory_bytes >= self.options.memtable_bytes:
            self.flush()

    def _hold(self, key: bytes, kind: int, value: bytes | None) -> None:
        self.memory.append((key, self.last_seq, kind, value))
        self.last_seq += 1
        self.memory_bytes += len(key) + len(value or b"") + 17

    def put_all(self, batch: DataFrame, order=("user_key",)) -> int:
        """Append a batch as one segment; rows are numbered in ``order``, a later one of a key winning."""
        return self.write_all(batch.withColumn("deleted", F.lit(False)), order)

    def write_all(self, batch: DataFrame, order=("user_key",), stream: tuple[str, int] | None = None) -> int:
        """As ``put_all``; rows whose column ``deleted`` is true are tombstones, after other rows of equal order.

        ``stream`` names a stream and the number of its batch, which are committed together with the rows.
        """
        gone = F.coalesce(F.col("deleted").cast("boolean"), F.lit(False))
        columns = {"user_key": F.col("user_key").cast("binary"), "value": F.when(~gone, F.col("value").cast("binary")), "kind": F.when(gone, DELETE).otherwise(PUT).cast("byte"), "_gone": gone}
        columns |= {f"_o{i}": F.col(c) for i, c in enumerate(order)}
        return self._write_batch(batch.select(*(c.alias(n) for n, c in columns.items())), [*(f"_o{i}" for i in range(len(order))), "_gone"], stream)

    def delete_all(self, keys: DataFrame) -> DataFrame:
        """Tombstones for the keys that are there; returns (user_key, deleted), readable until the next gc."""
        report = resolve.deletions(self.log(), keys.select(F.col("user_key").cast("binary").alias("user_key")), live=self.state["live_seq"])
        report = self._cut(report, "report")
        self._write_batch(report.filter("deleted").select("user_key", F.lit(None).cast("binary").alias("value"), F.lit(DELETE).cast("byte").alias("kind")), ["user_key"])
        return report

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.files.root}/tmp/{name}-{self.state['version']}-{self.last_seq}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write_batch(self, rows: DataFrame, order: list[str], stream: tuple[str, int] | None = None) -> int:
        n = self.options.fixed_key_length
        if 0 < n < 64:
            rows = rows.withColumn("user_key", F.when(F.octet_length("user_key") == n, F.col("user_key")).otherwise(F.raise_error(F.lit(f"keys have {n} bytes"))))
        self.flush()
        numbered = merge.number_rows(rows, self.last_seq, order, cut=lambda d: self._cut(d, "batch"))
        made = self._segments(numbered.select("user_key", F.col("seq").cast("long").alias("seq"), "kind", "value"), 0)
        for name in [n for n in self.files.names("tmp") if n.startswith("batch-")]:
            self.files.delete(f"tmp/{name}")
        if made or stream:
            self.last_seq = max([self.last_seq, *(s["max_seq"] + 1 for s in made)])
            self._commit(made, [], stream)
            self._maybe_compact()
        return sum(s["rows"] for s in made)

    def flush(self) -> None:
        """Write what single operations have left in memory as a level-0 segment."""
        if not self.memory:
            return
        made = self._segments(self.spark.createDataFrame(self.memory, LOG), 0)
        self.memory, self.memory_bytes = [], 0
        self._commit(made, [])
        for name in manifest.states(self.files.names("log")):
            if manifest.number_of(name) < self.last_seq:
                self.files.delete(f"log/{name}")
        self._maybe_compact()

    def _segments(self, rows: DataFrame, level: int, most: int = 0, tasks: int = 1) -> list[dict]:
        """Write key-clustered, sorted rows as one segment, or, where they may be more than ``segment_rows``, as segments
        of about so many by key range, several of them in a task; the records of those that have rows are returned.
        No files are left without rows.  ``most`` bounds the rows of a merge; without it all rows are one segment.
        """
        number, size = self.state["next_segment"], self.options.segment_rows
        self.state = self.state | {"next_segment": number + 1}
        name = f"seg-{number:06d}"
        if most > size:
            rows = merge.cut_runs(merge.sorted_runs(rows, partitions=tasks), size, -(-most // size), "part")
        else:
            rows = merge.sorted_runs(rows, partitions=self.options.segment_partitions).withColumn("part", F.lit(0))
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", self.options.rows_per_file)
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#user_key", "true")
        writer.partitionBy("part").parquet(f"{self.files.root}/{name}")
        with self._listing():
            made = self.spark.read.schema(StructType([*LOG.fields, StructField("part", LongType())])).parquet(f"{self.files.root}/{name}")
        facts = made.groupBy("part").agg(*_facts(), F.sum(F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16).alias("bytes")).orderBy("part").collect()  # a row for each part
        if not facts:
            self.files.delete(name)
        self.state = self.state | {"next_segment": number + max(1, len(facts))}
        return [{"id": number + i, "level": level, "path": f"{name}/part={x['part']}"} | {k: x[k] for k in (*_FACTS, "bytes")} for i, x in enumerate(facts)]

    @contextlib.contextmanager
    def _listing(self):
        """Many folders are listed by a few tasks; by default each is a task of its own."""
        name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(min(int(before), 4 * self.spark.sparkContext.defaultParallelism)))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _commit(self, added: list[dict], removed: list[int], stream: tuple[str, int] | None = None) -> None:
        gone = set(removed)
        segments = [s for s in self.state["segments"] if s["id"] not in gone] + added
        streams = self.state["streams"] | ({stream[0]: stream[1]} if stream else {})
        pending = min((m[1] for m in self.memory), default=self.last_seq)
        self.state = manifest.commit(self.files, self.state | {"segments": segments, "last_seq": pending, "streams": streams})

    def _read(self, *segments: dict) -> DataFrame:
        with self._listing():
            return self.spark.read.schema(LOG).option("parquet.page.verify-checksum.enabled", "true").parquet(*(f"{self.files.root}/{s['path']}" for s in segments))

    # ------------------------------------------------------------ reads

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions; segments whose key range is outside [low, high] are not even listed."""
        a, b = (None if k is None else bytes(k).hex().upper() for k in (low, high))
        some = [s for s in self.state["segments"] if (b is None or s["min_key"] <= b) and (a is None or s["max_key"] >= a)]
        rows = self._read(*some) if some else self.spark.createDataFrame([], LOG)
        if self.memory:
            rows = rows.unionByName(self.spark.createDataFrame(self.memory, LOG))
        if low is not None and low == high:
            return rows.filter(F.col("user_key") == F.lit(bytearray(low)))  # equality asks the files' Bloom filters
        if low is not None:
            rows = rows.filter(F.col("user_key") >= F.lit(bytearray(low)))
        if high is not None:
            rows = rows.filter(F.col("user_key") <= F.lit(bytearray(high)))
        return rows

    def get(self, key: bytes, as_of: int | None = None) -> tuple[Status, bytes | None]:
        self._fits(key)
        rows = resolve.snapshot(self.log(key, key), as_of)
        x = rows.agg(F.max("seq"), F.max_by("kind", "seq"), F.max_by("value", "seq")).first()
        if x[0] is None or x[1] == DELETE:
            return Status.NOT_FOUND, None
        if x[0] < self.state["live_seq"]:
            return Status.EXPIRED, None
        return Status.OK, bytes(x[2])

    def get_string(self, key: bytes) -> bytes:
        status, value = self.get(key)
        if status not in (Status.OK, Status.NOT_FOUND):
            log.warning("get: %s", status.value)
        return value if status.ok else b""

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        return resolve.multi_get(self.log(), keys, as_of, self.state["live_seq"])

    def scan(self, low: bytes, high: bytes, as_of: int | None = None) -> DataFrame:
        """(user_key, value) of all visible keys in the closed range, ascending."""
        rows = self.log(low, high) if low <= high else self.spark.createDataFrame([], LOG)
        return resolve.scan(rows, None, None, as_of, self.state["live_seq"]).select("user_key", "value")

    #: One plan serves both: tasks read segments in parallel anyway.
    scan_parallel = scan

    def full_scan(self) -> DataFrame:
        return resolve.scan(self.log(), None, None, None, self.state["live_seq"]).select("user_key", "value")

    # ------------------------------------------------------------ lifecycle

    def expire_at(self, seq: int) -> Status:
        """Versions up to ``seq`` expire; beyond the last number is corruption, before the watermark nothing happens."""
        if seq > self.last_seq:
            return Status.CORRUPTION
        if seq >= self.state["live_seq"]:
            self.state = manifest.commit(self.files, self.state | {"live_seq": seq + 1})
        return Status.OK

    def approximate_size(self) -> int:
        """Bytes of all segments' files."""
        return sum(self.files.size(s["path"]) for s in self.state["segments"])

    def memory_size(self) -> int:
        return self.memory_bytes

    def memory_contains(self, key: bytes) -> bool:
        return any(m[0] == key for m in self.memory)

    def level_files(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for s in self.state["segments"]:
            out[s["level"]] = out.get(s["level"], 0) + 1
        return out

    def memory_rows(self) -> int:
        return len(self.memory)

    def reset(self) -> None:
        """Drop all rows, files, numbers and the watermark."""
        self.memory, self.memory_bytes, self.last_seq = [], 0, 0
        self.state = manifest.commit(self.files, manifest.empty() | {"version": self.state["version"], "next_segment": self.state["next_segment"]})
        self.files.delete("log")
        self._sweep(0)

    def close(self) -> None:
        self.flush()

    def _maybe_compact(self) -> None:
        if sum(s["level"] == 0 for s in self.state["segments"]) >= self.options.l0_trigger:
            self.compact()

    def compact(self) -> int:
        """Push full levels down until none is full; returns the number of steps.  Versions and tombstones are kept."""
        steps, level = 0, 0
        while level <= max((s["level"] for s in self.state["segments"]), default=-1):
            inputs, below, how = compaction.plan(self.state["segments"], level, self.options)
            if how == "move":
                self._commit([s | {"level": level + 1} for s in inputs], [s["id"] for s in inputs])
            elif how == "merge":
                self._rewrite(inputs + below, level + 1, lambda rows: compaction.drop_expired(rows, self.state["live_seq"]))
            steps += how != "none"
            level += 1
        return steps

    def gc(self) -> Status:
        """Reclaim the room of shadowed and expired versions and of tombstones: all segments become one bottom segment."""
        self.flush()
        segments = self.state["segments"]
        if segments:
            level = max(s["level"] for s in segments)
            self._rewrite(segments, level, lambda rows: compaction.collapse(rows, self.state["live_seq"], bottom=True))
        self.files.delete("tmp")
        self._sweep(self.options.retain_seconds)
        manifest.prune_manifests(self.files)
        return Status.OK

    def _sweep(self, older: float) -> None:
        """Delete segments that the state doesn't name and that were committed more than so many seconds ago."""
        live: dict[str, set] = {}
        for s in self.state["segments"]:
            live.setdefault(s["path"].split("/")[0], set()).add(s["path"])
        for name in [n for n in self.files.names("") if n.startswith("seg-")]:
            mark = f"{name}/_SUCCESS"  # written once all parts are there
            whole = self.files.exists(mark)
            if whole and older and self.files.age(mark) <= older:
                continue
            if name not in live and (whole or not older):
                self.files.delete(name)
                continue
            parts = [f"{name}/{p}" for p in self.files.names(name) if p.startswith("part=")]
            for part in parts:
                if part not in live.get(name, ()) and (whole or not older or self.files.age(part) > older):
                    self.files.delete(part)
            if name not in live and not [p for p in self.files.names(name) if p.startswith("part=")]:
                self.files.delete(name)

    def _rewrite(self, inputs: list[dict], level: int, keep) -> None:
        """The inputs' rows that ``keep`` leaves, as segments of about ``segment_rows`` rows by key range."""
        rows, size = sum(s["rows"] for s in inputs), sum(s["bytes"] for s in inputs)
        tasks = min(-(-rows // self.options.segment_rows), max(self.spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES)))
        made = self._segments(keep(self._read(*inputs)), level, rows, tasks)
        self._commit(made, [s["id"] for s in inputs])

    def check(self) -> list[str]:
        """Segments whose rows don't agree with the manifest in number, bounds and checksum."""
        out = []
        for s in self.state["segments"]:
            x = self._read(s).agg(*_facts()).first()
            if any(x[k] != s[k] for k in _FACTS):
                out.append(s["path"])
        return out

    def filters(self, size: int = bloom.FILTER_BYTES) -> DataFrame:
        """(segment, words): a Bloom filter of each segment's keys."""
        rows = self.spark.createDataFrame([], "user_key binary, segment int")
        for s in self.state["segments"]:
            rows = rows.unionByName(self._read(s).select("user_key", F.lit(s["id"]).alias("segment")))
        return bloom.segment_filters(rows, size=size)
