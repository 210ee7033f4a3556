"""Continuous ingest: each micro-batch becomes one numbered batch of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.store import Store


def write_stream(rows: DataFrame, store: Store, checkpoint: str, order=("user_key",), trigger: dict | None = None):
    """Start a query that puts (user_key, value) rows, and deletes keys whose optional column ``deleted`` is true.

    Puts and deletes of a batch take effect in ``order``.  The state that names the batch's rows names its number too,
    so a batch that is delivered again after a failure is skipped, whenever the failure came.
    """
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def write(batch: DataFrame, number: int) -> None:
        if number <= store.state["streams"].get(name, -1):
            return
        if "deleted" not in batch.columns:
            batch = batch.withColumn("deleted", F.lit(False))
        store.write_all(batch, order, (name, number))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling or sliding window, with a watermark for late rows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def newest_stream(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The newest version of each key as state of a streaming aggregation (complete or update mode)."""
    return events.groupBy(key).agg(F.max(seq).alias(seq), *(F.max_by(c, seq).alias(c) for c in columns))
