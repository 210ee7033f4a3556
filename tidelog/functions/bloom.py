"""Bloom filters of byte keys: four 32-bit words of the 128-bit Murmur3 hash give the probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.checksum import murmur3, murmur3_128, murmur3_of
from tidelog.functions.keys import le_number

#: Bytes of a segment's filter.
FILTER_BYTES = 8192


def _probes(key: bytes, bits: int, double: bool) -> list[int]:
    out = []
    for word in np.frombuffer(murmur3_128(key, 1), dtype="<u4").tolist():
        out.append(word % bits)
        if double:
            turned = (word >> 17 | word << 15) & 0xFFFFFFFF
            out.append((word + turned) % (1 << 32) % bits)
    return out


def build(keys, size: int = FILTER_BYTES, double: bool = False) -> bytes:
    """A filter of ``size`` bytes; ``double`` probes twice for each word."""
    made = np.zeros(size, dtype=np.uint8)
    for key in keys:
        for bit in _probes(key, size * 8, double):
            made[bit >> 3] |= 1 << (bit & 7)
    return made.tobytes()


def sized(keys: list, bits_per_key: int = 8, double: bool = True) -> bytes:
    return build(keys, max(8, -(-len(keys) * bits_per_key // 8)), double)


def may_contain(key: bytes, made: bytes, double: bool = False) -> bool:
    """False if the key was certainly not added; a filter of less than two bytes holds nothing."""
    return len(made) >= 2 and all(made[bit >> 3] >> (bit & 7) & 1 for bit in _probes(key, len(made) * 8, double))


def segment_filters(log: DataFrame, segment: str = "segment", key: str = "user_key", size: int = FILTER_BYTES) -> DataFrame:
    """(segment, filter): partial filters are made where the rows are and joined by bitwise or."""
    kind = log.schema[segment].dataType.simpleString()

    def work(batches):
        made: dict = {}
        for b in batches:
            held = b.column("s").dictionary_encode()
            bits = (np.ascontiguousarray(murmur3_of(b.column("k").to_pylist())).view("<u4").reshape(-1, 4) % np.uint32(size * 8)).astype(np.int64)
            code = held.indices.to_numpy()
            for i, s in enumerate(held.dictionary.to_pylist()):
                own = made.setdefault(s, np.zeros(size, dtype=np.uint8))
                at = bits[code == i].ravel()
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for s, own in made.items():
            # Eight bytes of the filter a row, so that joining is an aggregate.
            words = own.view("<i8") if size % 8 == 0 else np.pad(own, (0, -size % 8)).view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"s": [s] * len(at), "i": at.astype(np.int32), "w": words[at]}, schema=pa.schema([("s", b.schema.field("s").type), ("i", pa.int32()), ("w", pa.int64())]))

    words = log.select(F.col(segment).alias("s"), F.col(key).cast("binary").alias("k")).mapInArrow(work, f"s {kind}, i int, w long").groupBy("s", "i").agg(F.bit_or("w").alias("w"))
    return words.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("words")).withColumnRenamed("s", segment)


def probe_filters(filters: DataFrame, keys: DataFrame, segment: str = "segment", key: str = "user_key", size: int = FILTER_BYTES) -> DataFrame:
    """(segment, key) pairs that may match, a row each: probes meet the filters' words by the words' places."""
    hashed = keys.select(F.col(key).alias("_k")).distinct().withColumn("_h", murmur3(F.col("_k").cast("binary")))
    bits = [F.pmod(le_number(F.substring("_h", 4 * i + 1, 4), 4).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(size * 8)) for i in range(4)]
    probes = hashed.select("_k", F.explode(F.array_distinct(F.array(*bits))).alias("_bit"), F.size(F.array_distinct(F.array(*bits))).alias("_all"))
    probes = probes.withColumn("_i", F.shiftright("_bit", 6).cast("int"))
    words = filters.select(segment, F.explode("words").alias("_i", "_w"))
    hit = probes.join(words, "_i").filter(F.getbit("_w", F.col("_bit").bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit.groupBy(segment, "_k").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all")).filter("_n = _all").select(segment, F.col("_k").alias(key))
