"""The newest visible version of each key.

What may be filtered before versions are resolved: key range, snapshot (seq <= as_of) and expiry (if the newest
version is expired, so are all).  What may not: the kind, since dropping a tombstone first would bring back what
it deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import PUT, Status


def snapshot(log: DataFrame, as_of=None, low=None, high=None, key: str = "user_key", seq: str = "seq") -> DataFrame:
    """The rows that a read at ``as_of`` over the closed key range [low, high] can see; low > high sees none."""
    for bound, test in ((as_of, F.col(seq) <= F.lit(as_of)), (low, F.col(key) >= F.lit(low)), (high, F.col(key) <= F.lit(high))):
        if bound is not None:
            log = log.filter(test)
    return log


def newest(log: DataFrame, key="user_key", seq: str = "seq") -> DataFrame:
    """Whole rows of each key's highest sequence number, tombstones included."""
    keys = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def newest_aggregate(log: DataFrame, columns: list[str], key: str = "user_key", seq: str = "seq") -> DataFrame:
    """As ``newest`` by aggregation, which combines before the shuffle; for few and narrow columns."""
    return log.groupBy(key).agg(F.max(seq).alias(seq), *(F.max_by(c, seq).alias(c) for c in columns))


def visible(log: DataFrame, as_of=None, live=None, low=None, high=None, key: str = "user_key", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """The newest version of each key, where it is a put and not expired (seq >= live)."""
    rows = snapshot(log, as_of, low, high, key, seq)
    if live is not None:
        rows = rows.filter(F.col(seq) >= F.lit(live))
    return newest(rows, key, seq).filter(F.col(kind) == PUT)


def scan(log: DataFrame, low, high, as_of=None, live=None, key: str = "user_key") -> DataFrame:
    return visible(log, as_of, live, low, high, key).orderBy(key)


def history(log: DataFrame, key: str = "user_key", seq: str = "seq") -> DataFrame:
    """Every version with its rank, 1 the newest."""
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc())))


def status_of(found_seq: Column, kind: Column, live: Column) -> Column:
    """A tombstone comes before expiry: a deleted key isn't found however old the deletion."""
    return F.when(found_seq.isNull() | (kind != PUT), Status.NOT_FOUND.value).when(found_seq < live, Status.EXPIRED.value).otherwise(Status.OK.value)


def multi_get(log: DataFrame, keys: DataFrame, as_of=None, live: int = 0, key: str = "user_key", seq: str = "seq", value: str = "value") -> DataFrame:
    """(key, status, value) of each distinct key asked for; no value unless OK."""
    asked = keys.select(key).distinct()
    rows = snapshot(log, as_of, key=key, seq=seq).join(asked, key, "left_semi")
    got = newest(rows, key, seq)
    out = asked.join(got, key, "left")
    status = status_of(F.col(seq), F.col("kind"), F.lit(live))
    return out.select(key, status.alias("status"), F.when(status == Status.OK.value, F.col(value)).alias("value"))


def get_string(found: DataFrame, key: str = "user_key") -> DataFrame:
    """Every failure is the empty string."""
    return found.select(key, F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))


def deletions(log: DataFrame, keys: DataFrame, as_of=None, live: int = 0, key: str = "user_key") -> DataFrame:
    """(key, deleted): whether each distinct key asked for is there to delete; others get no tombstone."""
    asked = keys.select(key).distinct()
    there = visible(snapshot(log, as_of, key=key).join(asked, key, "left_semi"), None, live, key=key).select(key, F.lit(True).alias("deleted"))
    return asked.join(there, key, "left").select(key, F.coalesce("deleted", F.lit(False)).alias("deleted"))
