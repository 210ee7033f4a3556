"""Compaction: policy over segment metadata, and the rewrite of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import PUT


def drop_expired(log: DataFrame, live: int, seq: str = "seq") -> DataFrame:
    """What a merge keeps: every version, tombstones too, that is not expired."""
    return log.filter(F.col(seq) >= F.lit(live))


def collapse(log: DataFrame, live: int = 0, bottom: bool = False, key: str = "user_key", seq: str = "seq") -> DataFrame:
    """Only the newest version of each key; tombstones too at the bottom level, where they hide nothing."""
    order = Window.partitionBy(key).orderBy(F.col(seq).desc())
    out = drop_expired(log, live, seq).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
    return out.filter(F.col("kind") == PUT) if bottom else out


def picked(level: int, files: int, l0_trigger: int = 4, fanout: int = 10) -> int:
    """How many files of a level go down: all of level 0 from the trigger on; elsewhere those over the size, and two."""
    if level == 0:
        return files if files >= l0_trigger else 0
    over = files - fanout**level
    return over + 2 if over >= 0 else 0


def picked_column(level: Column, files: Column, l0_trigger: int = 4, fanout: int = 10) -> Column:
    over = files - F.pow(F.lit(fanout), level)
    deeper = F.when(over >= 0, F.least(over + 2, files)).otherwise(0)
    return F.when(level == 0, F.when(files >= l0_trigger, files).otherwise(0)).otherwise(deeper).cast("long")


def zone_map(log: DataFrame, segment: str = "segment", key: str = "user_key", seq: str = "seq") -> DataFrame:
    return log.groupBy(segment).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"), F.count(F.lit(1)).alias("rows"))


def may_hold(zones: DataFrame, key) -> DataFrame:
    return zones.filter((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def overlapping(zones: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of segments whose closed user-key ranges meet; a row for each segment, not for each key, is compared."""
    a, b = zones.alias("a"), others.alias("b")
    return a.join(b, (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key")))


def plan(segments: list[dict], level: int, options) -> tuple[list[dict], list[dict], str]:
    """(inputs of the level, inputs of the next one, "none" | "move" | "merge") for the manifest's segments."""
    here = sorted((s for s in segments if s["level"] == level), key=lambda s: s["id"])
    inputs = here[: picked(level, len(here), options.l0_trigger, options.fanout)]
    if not inputs:
        return [], [], "none"
    low, high = min(s["min_key"] for s in inputs), max(s["max_key"] for s in inputs)
    below = [s for s in segments if s["level"] == level + 1 and s["min_key"] <= high and low <= s["max_key"]]
    move = not below and level != 0 and level + 1 < options.recluster_level
    return inputs, below, "move" if move else "merge"
