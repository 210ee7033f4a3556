"""What the operators share: scratch tables, worker set-up and vectorised text hashing.

Text is handled in Arrow batches.  A batch's texts lie back to back in one byte buffer, so words are
found, lower-cased and hashed with numpy over that buffer and no Python string is made.
"""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that are hashed at once; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Texts of a block, however short.
BLOCK_TEXTS = 4096
#: Rows and bytes of an Arrow batch: batches of whole texts end by bytes, those of numbers by rows.
BATCH_ROWS, BATCH_BYTES = 50_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Written tables in the shared folder of ``spark.checkpoint.dir``; they cut lineage and outlive executors.

    Where the setting is unset a temporary folder serves, but only on a local master: on a cluster no
    other machine would see it, so an error is raised instead.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = _local_base()
        self.base = f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, and not when the driver happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = hadoop.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


_LOCAL: list[str] = []


def _local_base() -> str:
    if not _LOCAL:
        import atexit

        _LOCAL.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


#: Seconds after which a task in work gives memory back.
TRIM_SECONDS = 1.0


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library that has no such call
        pass


def trimmed(work):
    """The work of a task, in which and after which the worker gives the memory that it no longer uses back to the
    machine: what one block has left would add to the next task's peak, and workers stay for later tasks of other kinds,
    beside which they would hold it."""

    def given(batches, last):
        for batch in batches:
            if time.monotonic() - last[0] > TRIM_SECONDS:
                _trim()
                last[0] = time.monotonic()
            yield batch

    def run(batches):
        yield from work(given(batches, [time.monotonic()]))
        _trim()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(n: int):
    """crc32 of the document id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % n


# ---------------------------------------------------------------- text buffers

#: Bytes that separate words: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(off) == 0:
        off = np.zeros(1, dtype=np.int64)
    if data is None:
        return np.empty(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES, texts: int = BLOCK_TEXTS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of about ``limit`` bytes, and of no more than ``texts`` texts."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n, i + texts)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words never cross texts."""
    if not len(data):
        return (np.empty(0, dtype=np.int64),) * 3
    word = ~SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = off[1:-1][off[1:-1] < len(data)]
    before[inner] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off[1:], start, side="right")


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the number of the text that it is in.

    Each eight bytes of a word are one integer, which is spread together with its place before a word's are added up:
    no step is linear in the bytes, so patterned words don't meet.
    """
    start, end, doc = word_spans(data, off)
    if not len(start):
        return np.empty(0, dtype=np.uint64), doc
    size = end - start
    first = np.cumsum(size) - size
    chars = LOWER[data[~SPACE[data]]].astype(np.uint64)
    place = np.arange(len(chars)) - np.repeat(first, size)
    chars <<= (place & 7).astype(np.uint64) << np.uint64(3)
    at = np.flatnonzero(place & 7 == 0)
    eight = np.add.reduceat(chars, at)
    with np.errstate(over="ignore"):
        eight = mix(eight + ((place[at] >> 3) + 1).astype(np.uint64) * STEP)
        count = (size + 7) >> 3
        return mix(np.add.reduceat(eight, np.cumsum(count) - count) + size.astype(np.uint64)), doc


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every run of n words of one text, and the number of that text."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for k in range(1, n):
            h = mix(h * STEP) + words[k : k + m]
        h = mix(h + np.uint64(n))
    same = doc[:m] == doc[n - 1 :]
    return h[same], doc[:m][same]


#: A group that holds one in so many of all rows is joined by broadcast; there are no more such groups than this.
HEAVY = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str) -> DataFrame:
    """Left join of rows with their groups, a written table of one row for each (long or binary) key, ``size`` being the group's rows.

    Groups that hold a ``HEAVY``-th of all rows meet their rows by broadcast.  In the join by shuffle those rows carry
    the hash of ``spread`` in the place of their key, as do rows with a null key, so no task gets a large group.
    """
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.filter(F.col(size) * HEAVY >= F.lit(total)).select(*keys, F.struct(*values).alias("_heavy"))
    rows = rows.join(F.broadcast(heavy), keys, "left")
    kind = {f.name: f.dataType for f in groups.schema}
    for i, c in enumerate(keys):
        other = F.xxhash64(F.lit(i), spread).cast("string").cast(kind[c]) if i == 0 else F.col(c)
        rows = rows.withColumn(f"_on{i}", F.when(F.col("_heavy").isNull() & F.col(c).isNotNull(), F.col(c)).otherwise(other))
    light = groups.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(keys)), F.struct(*values).alias("_light"))
    out = rows.join(light, [f"_on{i}" for i in range(len(keys))], "left").withColumn("_group", F.coalesce("_heavy", "_light"))
    return out.drop("_heavy", "_light", *(f"_on{i}" for i in range(len(keys)))).select("*", "_group.*").drop("_group")


_MARK = b"tidelog flat bytes"


def flat_broadcast(spark: SparkSession, data: np.ndarray):
    """A broadcast of bytes for ``flat_view``."""
    return spark.sparkContext.broadcast(_MARK + data.nbytes.to_bytes(8, "little") + data.tobytes())


def flat_view(shared) -> np.ndarray:
    """The bytes of a ``flat_broadcast``.  The workers of a machine map the one file that Spark has put there, where it
    is found as it was written; elsewhere each has a copy."""
    path = getattr(shared, "_path", None)
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            head = f.read(128)
        at = head.find(_MARK)
        if at >= 0:
            at += len(_MARK)
            size = int.from_bytes(head[at : at + 8], "little")
            if size and at + 8 + size <= os.path.getsize(path):
                return np.memmap(path, dtype=np.uint8, mode="r", offset=at + 8, shape=(size,))
    return np.frombuffer(shared.value, dtype=np.uint8)[len(_MARK) + 8 :]


# ---------------------------------------------------------------- Bloom filters that only save work

#: Bits of the largest filter: 32 MiB.  A fuller one lets more through, which costs time but no result.
BLOOM_BITS = 1 << 28


def _bloom_places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(3):
        with np.errstate(over="ignore"):
            yield (mix(h + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1))) & np.uint64(bits - 1)).astype(np.int64)


def bloom_of(values: DataFrame, scratch: Scratch, name: str) -> np.ndarray:
    """A filter of the one long column ``h`` of ``values``, a written table; tasks make parts, which are joined here."""
    count = values.count()
    bits = 1 << max(13, min(BLOOM_BITS.bit_length() - 1, (12 * count).bit_length()))

    def build(batches):
        made = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            for at in _bloom_places(h, bits):
                np.bitwise_or.at(made, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    parts = scratch.cut(values.coalesce(8).mapInArrow(trimmed(build), "bits binary"), f"{name}_bits")
    for row in parts.toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    scratch.drop(f"{name}_bits")
    return out


def in_bloom(made: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for at in _bloom_places(h, len(made) * 8):
        out &= (made[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
