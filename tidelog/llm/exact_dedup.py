"""Exact deduplication by skew-safe combining.

1. *Local*: equal texts are combined inside each map task (partial aggregation on digest and content).
2. *Salted*: what the tasks of one salt kept of a digest is combined.
3. *Global*: the salts' winners of a digest are combined.

Every stage groups by digest and full content, so texts that only share a digest stay apart.  A text
that a third of all rows hold reaches the first exchange as one row for each map task and the second as
one for each salt.  Members then find their group by digest alone, without moving text; rows of a group that holds
much of the table find it by broadcast, so no digest's members meet in one task.  Only where one digest stands for
several contents, which the groups show, the content is compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, join_groups

#: Rows of one text that different map tasks kept meet in so many groups before the last stage.
SALTS = 16


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise=None, salts: int = SALTS) -> DataFrame:
    """One row for each input row: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the row with the largest key stays; a null key is smaller than any
    other.  Rows that repeat key and text count in group_size, and all that carry the largest key are marked kept.
    ``normalise`` maps the text column before it is compared.  Texts of any length are compared whole.  An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    content: Column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if normalise is not None:
        content = normalise(content)
    rows = docs.select(F.col(key).alias("k"), content.alias("t")).withColumn("d", F.unhex(F.sha2("t", 256)))
    salted = rows.groupBy("d", "t", (F.spark_partition_id() % salts).alias("s")).agg(F.max("k").alias("keep"), F.count(F.lit(1)).alias("n"))
    contents = salted.groupBy("d", "t").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    groups = scratch.cut(contents.groupBy("d").agg(F.count(F.lit(1)).alias("contents"), F.max("keep").alias("keep"), F.max("n").alias("n"), F.sum("n").alias("rows")), "groups")
    out = join_groups(rows.select("k", "d"), groups, ["d"], "rows", "k").filter("contents = 1").select("k", "d", "keep", "n")
    if not groups.filter("contents > 1").isEmpty():
        clash = groups.filter("contents > 1").select("d")
        again = contents.join(clash, "d", "left_semi")
        out = out.unionByName(rows.join(clash, "d", "left_semi").join(again, ["d", "t"]).select("k", "d", "keep", "n"))
    return out.select(
        F.col("k").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("k").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("d")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows that stay, one of each text, with all their columns.

    As in ``deduplicate`` the largest key stays and null texts count as empty.  The winner travels with the stages'
    content, so rows are not looked up again.  Of rows that repeat the key the one with the largest hash of its other
    columns stays.
    """
    others = [c for c in docs.columns if c != text]
    hashed = [f.name for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(key), F.xxhash64(*hashed).alias("h"), F.col(text).isNotNull().alias("set"))
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"), order.alias("_o"), F.struct(*others, F.col(text).isNull().alias("_null")).alias("_row"))
    rows = rows.withColumn("_d", F.unhex(F.sha2("_t", 256)))
    best = [F.max_by("_row", "_o").alias("_row"), F.max("_o").alias("_o")]
    salted = rows.groupBy("_d", "_t", (F.spark_partition_id() % salts).alias("_s")).agg(*best)
    kept = salted.groupBy("_d", "_t").agg(*best)
    whole = F.when(~F.col("_row._null"), F.col("_t"))
    return kept.select(*(whole.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))
