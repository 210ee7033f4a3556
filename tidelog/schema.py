"""Types, constants and status codes of versioned tables."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequence numbers have 56 usable bits.
MAX_SEQ = (1 << 56) - 1

LOG = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


class Status(Enum):
    OK = "OK"
    NOT_FOUND = "NOT_FOUND"
    CORRUPTION = "CORRUPTION"
    NOT_SUPPORTED = "NOT_SUPPORTED"
    INVALID_ARGUMENT = "INVALID_ARGUMENT"
    IO_ERROR = "IO_ERROR"
    BACKGROUND_ERROR = "BACKGROUND_ERROR"
    EXPIRED = "EXPIRED"

    @property
    def ok(self) -> bool:
        return self is Status.OK


class StoreError(Exception):
    """An operation that ended with a status other than OK."""

    def __init__(self, status: Status, message: str = ""):
        super().__init__(f"{status.value}: {message}")
        self.status = status


class Options:
    """Tunables.  The policy's shape follows the classic leveled layout; sizes are those that suit Parquet on a cluster."""

    def __init__(self, l0_trigger: int = 4, fanout: int = 10, recluster_level: int = 3, fixed_key_length: int = 0, memtable_bytes: int = 4 << 20, rows_per_file: int = 5_000_000, segment_partitions: int = 0, bloom: bool = True, segment_rows: int = 50_000_000, durable: bool = True, retain_seconds: float = 900):
        self.l0_trigger, self.fanout, self.recluster_level = l0_trigger, fanout, recluster_level
        self.fixed_key_length, self.memtable_bytes = fixed_key_length, memtable_bytes
        self.rows_per_file, self.segment_partitions, self.bloom = rows_per_file, segment_partitions, bloom
        #: Rows of a segment that a merge writes; whether single operations are on disk before they return; seconds for
        #: which readers may still use files that no state names any more.
        self.segment_rows, self.durable, self.retain_seconds = segment_rows, durable, retain_seconds
