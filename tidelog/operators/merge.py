"""Writes and merges of versioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.scratch import kept


def number_rows(rows: DataFrame, base: int, order, name: str = "seq", cut=kept) -> DataFrame:
    """Dense numbers from ``base`` in the given order, without one task that sorts everything.

    Rows are range-partitioned, sorted and written by ``cut``, so that counts and rows are of one partitioning however
    often, and with whatever columns, the result is read.  The partitions' counts, a row each, give the offsets.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    dealt = cut(dealt)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_at") - F.col("_first") + F.lit(base)).drop("_part", "_at", "_n", "_first", "_off")


def equal_parts(rows: DataFrame, parts: int, order, name: str = "part") -> DataFrame:
    """Numbers from 1 of ``parts`` runs of the order, whose sizes differ by one at most, the larger ones first."""
    placed = number_rows(rows, 0, order, "_place")
    size, larger = divmod(placed.count(), parts)
    head = larger * (size + 1)
    part = F.when(F.col("_place") < head, F.floor(F.col("_place") / (size + 1))).otherwise(larger + F.floor((F.col("_place") - head) / max(size, 1)))
    return placed.withColumn(name, (part + 1).cast("int")).drop("_place")


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    return log.unionByName(batch)


def first_source_wins(sources: list[DataFrame], key: str = "user_key", seq: str = "seq") -> DataFrame:
    """Merge of per-source newest rows, where an earlier source is newer than a later one for every key."""
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    order = Window.partitionBy(key).orderBy("_source", F.col(seq).desc())
    return every.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_source")


def sorted_runs(log: DataFrame, key: str = "user_key", seq: str = "seq", partitions: int = 0) -> DataFrame:
    """Key-clustered runs: each partition holds a key range, sorted by key and newest first; a key isn't split."""
    dealt = log.repartitionByRange(partitions, key) if partitions else log.repartitionByRange(key)
    return dealt.sortWithinPartitions(F.col(key).asc(), F.col(seq).desc())


def cut_runs(runs: DataFrame, size: int, most: int, name: str = "part", key: str = "user_key", seq: str = "seq") -> DataFrame:
    """The runs of ``sorted_runs`` cut into parts, numbered in key order, at the first key that begins ``size`` or more rows
    after the part's place in its run; a key isn't split.  No run is cut into more than ``most`` parts.

    The partitioning and order of the runs serve the window, so rows stay where they are.
    """
    at = runs.withColumn("_at", F.monotonically_increasing_id())
    first = F.col("_at") - F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc())) + 1
    run, place = F.shiftright(first, 33), first.bitwiseAND(F.lit((1 << 33) - 1))
    parts = at.withColumn(name, run * most + F.floor(place / size)).drop("_at")
    return parts.sortWithinPartitions(name, F.col(key).asc(), F.col(seq).desc())


def dereference(pointers: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Values of pointer rows: the join that separate key and value files need."""
    return pointers.join(values, on)
