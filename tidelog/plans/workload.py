"""Workload generators and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform_keys(spark: SparkSession, operations: int, keys: int, seed: int = 0) -> DataFrame:
    return spark.range(operations).select(F.col("id").alias("op"), F.floor(F.rand(seed) * keys).cast("long").alias("key"))


#: Bytes of random keys, which meet the edges of byte order.
KEY_BYTES = "00016162636465fdfeff"


def random_keys(spark: SparkSession, rows: int, length: int, seed: int = 0) -> DataFrame:
    """(op, key): byte strings of KEY_BYTES, a function of the seed and the row."""
    return spark.range(rows).select(F.col("id").alias("op"), F.unhex(_drawn(KEY_BYTES, 2, length, seed)).alias("key"))


def random_strings(spark: SparkSession, rows: int, length: int, seed: int = 0) -> DataFrame:
    """(op, value): printable ASCII strings, a function of the seed and the row."""
    return spark.range(rows).select(F.col("id").alias("op"), _drawn("".join(map(chr, range(32, 127))), 1, length, seed).alias("value"))


def _drawn(letters: str, width: int, length: int, seed: int):
    n = len(letters) // width
    place = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(n)) * width + 1).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit(letters), place(i), F.lit(width))), "") if length else F.lit("")


def zipf_weights(spark: SparkSession, keys: int, exponent: float = 0.99) -> DataFrame:
    """(key, low, high): each key's share of [0, 1), proportional to 1 / rank ** exponent."""
    w = spark.range(1, keys + 1).select((F.col("id") - 1).alias("key"), F.pow(F.col("id"), F.lit(-exponent)).alias("w"))
    upto = F.sum("w").over(Window.orderBy("key")) / F.sum("w").over(Window.partitionBy())
    w = w.withColumn("high", upto)
    return w.select("key", F.coalesce(F.lag("high").over(Window.orderBy("key")), F.lit(0.0)).alias("low"), "high")


def zipf_keys(spark: SparkSession, operations: int, keys: int, exponent: float = 0.99, seed: int = 0) -> DataFrame:
    """Keys by the inverse of the distribution; draws and shares meet in buckets of [0, 1)."""
    cells = max(1, min(1000, keys))
    shares = zipf_weights(spark, keys, exponent)
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * cells))))
    draws = spark.range(operations).select(F.col("id").alias("op"), F.rand(seed).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(shares, "cell").filter("u >= low and u < high").select("op", "key")


def mix(operations: DataFrame, reads: int, writes: int, op: str = "op") -> DataFrame:
    """``kind`` get or put: of every reads + writes operations the first ``reads`` are gets."""
    return operations.withColumn("kind", F.when(F.pmod(F.col(op), F.lit(reads + writes)) < reads, "get").otherwise("put"))


def latency(samples: DataFrame, value: str, seconds: float | None = None) -> DataFrame:
    out = samples.agg(F.count(F.lit(1)).alias("ops"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.99) within group (order by {value})").alias("p99"))
    return out if seconds is None else out.withColumn("ops_per_second", F.col("ops") / F.lit(seconds))
