"""Registered queries of the versioned-table engine, each beside its DuckDB SQL.

``events`` serves as a log: the user is the key, the event id the sequence number, an error event a tombstone.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, checksum, keys, order, regression
from tidelog.operators import compaction, merge, resolve
from tidelog.plans import workload
from tidelog.plans.scratch import importable, shared_folder
from tidelog.plans.store import Store
from tidelog.schema import Options
from tidelog.sources import kv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LOG_SQL = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""

#: A segment of flush order, and a block of a key-sorted run, have so many rows.
SEGMENT_ROWS, BLOCK_ROWS = 360, 128


def query(sql: str | None):
    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql.replace("{LOG}", LOG_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"), "value")


def clustered(log: DataFrame, segments: int = 28) -> DataFrame:
    """Compacted, key-clustered segments: ranges of keys as they stand in the sorted log."""
    return merge.equal_parts(log, segments, ["k", F.col("seq").desc()], "segment")


def flushed(log: DataFrame) -> DataFrame:
    return log.withColumn("segment", F.floor(F.col("seq") / SEGMENT_ROWS))


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1 AND k BETWEEN '1' AND '5'")
def kv_scan_range(spark, sf_dir):
    return resolve.scan(events_log(spark, sf_dir), "1", "5", key="k").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1")
def kv_scan_all(spark, sf_dir):
    return resolve.visible(events_log(spark, sf_dir), key="k").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1 AND k BETWEEN '5' AND '1'")
def kv_scan_reversed(spark, sf_dir):
    return resolve.scan(events_log(spark, sf_dir), "5", "1", key="k").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, value FROM newest WHERE kind = 1 AND k = '7'")
def kv_get(spark, sf_dir):
    return resolve.visible(events_log(spark, sf_dir), low="7", high="7", key="k").select("k", "value")


_LOOKUPS = [str(i) for i in range(1, 60, 3)] + ["none", "", "-5"]


@query(
    """WITH {LOG}, asked AS (SELECT unnest([CAST(i AS VARCHAR) FOR i IN range(1, 60, 3)] || ['none', '', '-5']) AS k)
    SELECT a.k, CASE WHEN n.seq IS NULL OR n.kind = 0 THEN 'NOT_FOUND' WHEN n.seq < 500 THEN 'EXPIRED' ELSE 'OK' END AS status,
           CASE WHEN n.kind = 1 AND n.seq >= 500 THEN n.value END AS value
    FROM asked a LEFT JOIN newest n ON a.k = n.k"""
)
def kv_multi_get_status(spark, sf_dir):
    asked = spark.createDataFrame([(k,) for k in _LOOKUPS], "k string")
    return resolve.multi_get(events_log(spark, sf_dir), asked, live=500, key="k")


@query(
    """WITH {LOG}, asked AS (SELECT unnest([CAST(i AS VARCHAR) FOR i IN range(1, 60, 3)] || ['none', '', '-5']) AS k)
    SELECT a.k, coalesce(CASE WHEN n.kind = 1 AND n.seq >= 500 THEN CAST(round(n.value) AS BIGINT)::VARCHAR END, '') AS value
    FROM asked a LEFT JOIN newest n ON a.k = n.k"""
)
def kv_get_string(spark, sf_dir):
    asked = spark.createDataFrame([(k,) for k in _LOOKUPS], "k string")
    log = events_log(spark, sf_dir).withColumn("value", F.bround("value").cast("long").cast("string"))
    return resolve.get_string(resolve.multi_get(log, asked, live=500, key="k"), "k")


@query(
    """WITH {LOG}, old AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= 500)
    SELECT k, seq, value FROM old WHERE rn = 1 AND kind = 1"""
)
def kv_latest_asof(spark, sf_dir):
    return resolve.visible(events_log(spark, sf_dir), as_of=500, key="k").select("k", "seq", "value")


@query(
    """WITH {LOG}, old AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= 500)
    SELECT k, seq, value FROM old WHERE rn = 1 AND kind = 1"""
)
def kv_latest_asof_aggregate(spark, sf_dir):
    log = resolve.snapshot(events_log(spark, sf_dir), 500, key="k")
    return resolve.newest_aggregate(log, ["kind", "value"], "k").filter("kind = 1").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1 AND seq >= 980")
def kv_visible_expired(spark, sf_dir):
    return resolve.visible(events_log(spark, sf_dir), live=980, key="k").select("k", "seq", "value")


@query(
    """WITH {LOG}, asked AS (SELECT unnest([CAST(i AS VARCHAR) FOR i IN range(1, 60, 3)] || ['none', '', '-5']) AS k)
    SELECT a.k, coalesce(n.kind = 1, false) AS deleted FROM asked a LEFT JOIN newest n ON a.k = n.k"""
)
def kv_delete_batch(spark, sf_dir):
    asked = spark.createDataFrame([(k,) for k in _LOOKUPS], "k string")
    return resolve.deletions(events_log(spark, sf_dir), asked, key="k")


def _customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("k"), F.lit(1).alias("kind"), F.col("c_acctbal").alias("value"), "c_custkey")


def _merged(spark, sf_dir, batch: DataFrame) -> DataFrame:
    log = events_log(spark, sf_dir)
    base = log.agg(F.max("seq")).first()[0] + 1
    batch = merge.number_rows(batch, base, "c_custkey").select("k", "seq", "kind", "value")
    return resolve.visible(merge.append(log, batch), key="k").select("k", "seq", "value")


@query(
    """WITH {LOG}, both_ AS (
      SELECT * FROM log UNION ALL
      SELECT CAST(c_custkey AS VARCHAR), (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY c_custkey), 1, c_acctbal FROM customer)
    SELECT k, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM both_) WHERE rn = 1 AND kind = 1"""
)
def kv_put_merge_all(spark, sf_dir):
    return _merged(spark, sf_dir, _customers(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, 5000 + row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer")
def kv_sequence_all(spark, sf_dir):
    return merge.number_rows(_customers(spark, sf_dir), 5000, "c_custkey").select("k", "seq")


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1")
def kv_source_merge(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return merge.first_source_wins([log.filter("seq >= 500"), log.filter("seq < 500")], "k").filter("kind = 1").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1")
def kv_value_deref(spark, sf_dir):
    log = events_log(spark, sf_dir)
    pointers = resolve.visible(log.select("k", "seq", "kind"), key="k").select("k", "seq")
    return merge.dereference(pointers, log.select("seq", "value"), ["seq"]).select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, kind, value FROM log WHERE seq >= 400")
def kv_compact_drop(spark, sf_dir):
    return compaction.drop_expired(events_log(spark, sf_dir), 400)


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1 AND seq >= 400")
def kv_compact_equiv(spark, sf_dir):
    return resolve.visible(compaction.drop_expired(events_log(spark, sf_dir), 400), key="k").select("k", "seq", "value")


@query("WITH {LOG} SELECT k, seq, kind, value FROM newest WHERE kind = 1 AND seq >= 400")
def kv_collapse(spark, sf_dir):
    return compaction.collapse(events_log(spark, sf_dir), 400, bottom=True, key="k")


@query("WITH {LOG} SELECT CAST(seq // 360 AS BIGINT) AS segment, count(*) AS rows FROM log GROUP BY 1")
def kv_segments(spark, sf_dir):
    return flushed(events_log(spark, sf_dir)).groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH {LOG} SELECT CAST(seq // 360 AS BIGINT) AS segment, min(k) AS min_key, max(k) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS rows FROM log GROUP BY 1")
def kv_zone_map(spark, sf_dir):
    return compaction.zone_map(flushed(events_log(spark, sf_dir)), key="k")


_CLUSTERED = """WITH {LOG}, c AS (SELECT *, ntile(28) OVER (ORDER BY k, seq DESC) AS segment FROM log),
    z AS (SELECT CAST(segment AS INTEGER) AS segment, min(k) AS min_key, max(k) AS max_key FROM c GROUP BY 1)"""


@query(_CLUSTERED + " SELECT segment FROM z WHERE min_key <= '42' AND max_key >= '42'")
def kv_prune(spark, sf_dir):
    return compaction.may_hold(compaction.zone_map(clustered(events_log(spark, sf_dir)), key="k"), "42").select("segment")


@query(_CLUSTERED + " SELECT a.segment AS one, b.segment AS two FROM z a JOIN z b ON a.min_key <= b.max_key AND b.min_key <= a.max_key AND a.segment < b.segment")
def kv_overlap(spark, sf_dir):
    z = compaction.zone_map(clustered(events_log(spark, sf_dir)), key="k")
    return compaction.overlapping(z, z).filter("a.segment < b.segment").select(F.col("a.segment").alias("one"), F.col("b.segment").alias("two"))


@query(
    """WITH {LOG}, s AS (SELECT DISTINCT seq // 360 AS segment FROM log), l AS (SELECT CAST(segment % 3 AS INTEGER) AS level, count(*) AS files FROM s GROUP BY 1)
    SELECT level, files, CAST(CASE WHEN level = 0 THEN CASE WHEN files >= 4 THEN files ELSE 0 END
           WHEN files >= 10 ** level THEN least(files - 10 ** level + 2, files) ELSE 0 END AS BIGINT) AS picked FROM l"""
)
def kv_level_policy(spark, sf_dir):
    s = flushed(events_log(spark, sf_dir)).select("segment").distinct().groupBy((F.col("segment") % 3).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("files"))
    return s.withColumn("picked", compaction.picked_column(F.col("level"), F.col("files")))


@query("WITH {LOG} SELECT CAST(sum(strlen(k) + 24) AS BIGINT) AS bytes FROM log")
def kv_vlog_bytes(spark, sf_dir):
    return events_log(spark, sf_dir).agg(F.sum(F.octet_length("k") + 24).alias("bytes"))


@query(
    """WITH {LOG} SELECT CAST(l.seq // 360 AS BIGINT) AS segment, CAST(sum(CASE WHEN n.k IS NOT NULL THEN strlen(l.k) + 24 ELSE 0 END) AS BIGINT) AS live_bytes,
           CAST(sum(CASE WHEN n.k IS NULL THEN strlen(l.k) + 24 ELSE 0 END) AS BIGINT) AS dead_bytes
    FROM log l LEFT JOIN (SELECT * FROM newest WHERE kind = 1) n ON l.seq = n.seq GROUP BY 1"""
)
def kv_vlog_gc(spark, sf_dir):
    log = flushed(events_log(spark, sf_dir))
    live = resolve.visible(log.select("k", "seq", "kind"), key="k").select("seq", F.lit(True).alias("live"))
    size = F.octet_length("k") + 24
    both = log.join(live, "seq", "left")
    return both.groupBy("segment").agg(F.sum(F.when(F.col("live"), size).otherwise(0)).alias("live_bytes"), F.sum(F.when(F.col("live"), 0).otherwise(size)).alias("dead_bytes"))


@query("WITH {LOG} SELECT k, seq, kind, value, CAST(row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS INTEGER) AS rn FROM log")
def kv_history(spark, sf_dir):
    return resolve.history(events_log(spark, sf_dir), "k")


@query("WITH {LOG} SELECT k, CAST(sum(kind) AS BIGINT) AS puts, CAST(sum(1 - kind) AS BIGINT) AS deletes, CAST(arg_max(kind, seq) AS INTEGER) AS live FROM log GROUP BY k")
def kv_tombstone_stats(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("k").agg(F.sum("kind").alias("puts"), F.sum(1 - F.col("kind")).alias("deletes"), F.max_by("kind", "seq").alias("live"))


def lineitem_log(spark, sf_dir) -> DataFrame:
    """Versions of parts: the order of all columns that together are unique."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(F.col("l_partkey").alias("k"), F.row_number().over(w).alias("seq"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


_LINES = "lines_ AS (SELECT l_partkey AS k, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS seq, l_extendedprice, l_orderkey FROM lineitem)"


@query(f"WITH {_LINES} SELECT k, seq, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM lines_) WHERE rn = 1")
def kv_lineitem_versions(spark, sf_dir):
    return resolve.newest(lineitem_log(spark, sf_dir), "k").select("k", "seq", "l_orderkey", "l_extendedprice")


@query("SELECT o_custkey AS k, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def kv_orders_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return resolve.newest_aggregate(o, ["value"], "k")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def kv_documents_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source")).select("doc_id", "source")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def kv_conversations_last(spark, sf_dir):
    return resolve.newest(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def positions(spark, sf_dir) -> DataFrame:
    """Positions of part versions in key-clustered blocks, 40 bytes an entry, by each supplier as a segment."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    p = li.select(F.col("l_suppkey").alias("segment"), F.col("l_partkey").alias("key"), (F.row_number().over(w) - 1).alias("n"))
    return p.withColumn("pos", F.col("n") * regression.ENTRY_BYTES)


_POS = "p AS (SELECT l_suppkey AS segment, l_partkey AS key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) - 1 AS n, 40 * (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) - 1) AS pos FROM lineitem)"


@query(f"WITH {_POS} SELECT segment, n // 128 AS block, max(key) AS last_key FROM p GROUP BY 1, 2")
def kv_sparse_index(spark, sf_dir):
    p = positions(spark, sf_dir)
    return p.groupBy("segment", F.floor(F.col("n") / BLOCK_ROWS).alias("block")).agg(F.max("key").alias("last_key"))


@query(f"WITH {_POS}, i AS (SELECT segment, n // 128 AS block, max(key) AS last_key FROM p GROUP BY 1, 2) SELECT segment, min(block) AS block FROM i WHERE last_key >= 100 GROUP BY 1")
def kv_index_lookup(spark, sf_dir):
    return kv_sparse_index(spark, sf_dir).filter("last_key >= 100").groupBy("segment").agg(F.min("block").alias("block"))


@query(f"WITH {_POS} SELECT segment, count(*) AS n, round(coalesce(regr_slope(pos, key), 0), 4) AS slope, round(coalesce(regr_intercept(pos, key), avg(pos)), 3) AS intercept FROM p GROUP BY 1")
def kv_index_fit(spark, sf_dir):
    f = regression.fit(positions(spark, sf_dir), "segment", "key", "pos")
    return f.select("segment", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(
    f"""WITH {_POS}, f AS (SELECT segment, regr_slope(pos, key) AS a, regr_intercept(pos, key) AS b FROM p GROUP BY 1)
    SELECT segment, CAST(max(abs(round(a * key + b) - pos)) AS BIGINT) AS worst, count(*) AS n FROM p JOIN f USING (segment) GROUP BY 1"""
)
def kv_predict_error(spark, sf_dir):
    p = positions(spark, sf_dir)
    f = regression.fit(p, "segment", "key", "pos").drop("n")
    guess = regression.predict(F.col("slope"), F.col("intercept"), F.col("key"))
    return p.join(f, "segment").groupBy("segment").agg(F.max(F.abs(guess - F.col("pos"))).cast("long").alias("worst"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, lpad(upper(hex(event_id)), 16, '0') AS be, row_number() OVER (ORDER BY lpad(upper(hex(event_id)), 16, '0')) - 1 AS place FROM events")
def kv_be_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", keys.be_key(F.col("event_id")).alias("b"))
    ranked = merge.number_rows(e, 0, "b", "place")
    return ranked.select("event_id", F.hex("b").alias("be"), "place")


@query(
    """WITH n AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS p FROM (SELECT DISTINCT user_id AS u FROM events))
    SELECT a.u AS one, b.u AS two, CAST(a.u AS VARCHAR) < CAST(b.u AS VARCHAR) AS text_less, a.u < b.u AS number_less
    FROM n a JOIN n b ON b.p = a.p * 7 % (SELECT count(*) FROM n)"""
)
def kv_key_compare_all(spark, sf_dir):
    """Each user is compared with the one at seven times its place in number order."""
    n = table(spark, sf_dir, "events").select(F.col("user_id").alias("one")).distinct()
    users = n.count()
    placed = merge.number_rows(n, 0, "one", "p")
    a, b = placed.withColumn("other", F.col("p") * 7 % F.lit(users)), placed.select(F.col("one").alias("two"), F.col("p").alias("q"))
    return _compared(a.join(b, F.col("other") == F.col("q")).select("one", "two"))


def _compared(pairs: DataFrame) -> DataFrame:
    """Adds how (one, two) compare as decimal text and as numbers."""
    text = lambda c: F.col(c).cast("string").cast("binary")
    le = lambda c: keys.le_fixed(F.col(c), 8)
    return pairs.withColumns({"text_less": order.BYTEWISE.less(text("one"), text("two")), "number_less": order.NUMERIC.less(le("one"), le("two"))})


@query("SELECT event_id, greatest(CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS larger, least(CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS smaller FROM events")
def kv_key_extremes(spark, sf_dir):
    a, b = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", order.BYTEWISE.greatest(a, b).alias("larger"), order.BYTEWISE.least(a, b).alias("smaller"))


@query(
    """SELECT event_id, lpad(upper(hex(user_id)), 16, '0') || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS packed, event_id AS seq, 1 AS kind
    FROM (SELECT *, lpad(upper(hex(event_id * 256 + 1)), 16, '0') AS h FROM events)"""
)
def kv_internal_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", keys.internal_key(keys.be_key(F.col("user_id")), F.col("event_id"), F.lit(1)))
    return e.select("event_id", F.hex("p").alias("packed"), keys.internal_seq(F.col("p")).alias("seq"), keys.internal_kind(F.col("p")).cast("int").alias("kind"))


@query("SELECT event_id % 100 < 10 AS is_get, count(*) AS ops FROM events GROUP BY 1")
def kv_ycsb_mix(spark, sf_dir):
    m = workload.mix(table(spark, sf_dir, "events"), 10, 90, "event_id")
    return m.groupBy((F.col("kind") == "get").alias("is_get")).agg(F.count(F.lit(1)).alias("ops"))


@query("SELECT count(*) AS ops, round(avg(value), 6) AS mean, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events")
def kv_latency_stats(spark, sf_dir):
    return workload.latency(table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("WITH {LOG}, s AS (SELECT DISTINCT seq // 360 AS segment FROM log) SELECT CAST(segment % 3 AS INTEGER) AS level, count(*) AS files FROM s GROUP BY 1")
def kv_level_files(spark, sf_dir):
    s = flushed(events_log(spark, sf_dir)).select("segment").distinct()
    return s.groupBy((F.col("segment") % 3).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("files"))


@query("WITH {LOG} SELECT k, seq, kind FROM log WHERE length(k) = 2")
def kv_fixed_length(spark, sf_dir):
    return events_log(spark, sf_dir).filter(F.octet_length("k") == 2).select("k", "seq", "kind")


@query(
    """WITH n AS (SELECT k, first(nxt) AS nxt FROM (SELECT CAST(p_name AS VARCHAR) AS k, lead(p_name) OVER (ORDER BY p_name) AS nxt FROM (SELECT DISTINCT p_name FROM part)) GROUP BY k),
    d AS (SELECT k, nxt, (SELECT min(i) FROM range(1, 200) t(i) WHERE i <= least(strlen(k), strlen(nxt)) AND substr(k, i, 1) <> substr(nxt, i, 1)) AS i FROM n WHERE nxt IS NOT NULL)
    SELECT k, CASE WHEN i IS NOT NULL AND ord(substr(k, i, 1)) + 1 < ord(substr(nxt, i, 1)) THEN substr(k, 1, i - 1) || chr(ord(substr(k, i, 1)) + 1) ELSE k END AS separator,
           chr(ord(k) + 1) AS successor FROM d"""
)
def kv_separators(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("k")).distinct()
    placed = merge.number_rows(n, 0, "k", "p")
    n = placed.join(placed.select(F.col("k").alias("nxt"), (F.col("p") - 1).alias("p")), "p")
    a, b = F.col("k").cast("binary"), F.col("nxt").cast("binary")
    return n.select("k", order.shortest_separator(a, b).cast("string").alias("separator"), order.short_successor(a).cast("string").alias("successor"))


#: Tables of both checksums by their rule, and folds over the bytes of a text.
_CRC_SQL = """WITH t AS (SELECT
      list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT)] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)) AS t32,
      list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT) << 8] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda c, z: CASE WHEN c & 32768 <> 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END)) AS t16),
    p AS (SELECT DISTINCT props, list_transform(range(strlen(props)), lambda i: CAST('0x' || substr(hex(encode(props)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM events),
    c AS (SELECT props,
      xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t32[(xor(c, b) & 255) + 1])), 4294967295) AS crc32c,
      CAST(list_reduce([65535] || bytes, lambda c, b: xor(t16[xor(c >> 8, b) + 1], c << 8) & 65535) AS INTEGER) AS crc16 FROM p, t)
    SELECT event_id, crc32c, crc16 FROM events e LEFT JOIN c ON e.props IS NOT DISTINCT FROM c.props"""


@query(_CRC_SQL)
def kv_crc32c(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", checksum.crc32c(F.col("props").cast("binary")).alias("crc32c"), checksum.crc16(F.col("props").cast("binary")).alias("crc16"))


@query(None)
def kv_murmur3(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(checksum.murmur3(F.col("p_name").cast("binary"))).alias("hash"))


@query(None)
def kv_bloom_fpr(spark, sf_dir):
    """Share of segments' filters that let absent keys through."""
    log = clustered(events_log(spark, sf_dir))
    absent = spark.range(1000).select(F.concat(F.lit("absent-"), "id").alias("k"))
    filters = bloom.segment_filters(log, key="k", size=1024)
    hits = bloom.probe_filters(filters, absent, key="k", size=1024).groupBy("segment").agg(F.count(F.lit(1)).alias("hits"))
    return filters.select("segment").join(hits, "segment", "left").select("segment", (F.coalesce("hits", F.lit(0)) / 1000).alias("rate"))


@query(None)
def kv_plr(spark, sf_dir):
    """Lines of each index block of ``BLOCK_ROWS`` rows."""
    p = positions(spark, sf_dir).withColumn("block", F.shiftleft("segment", 24) + F.floor(F.col("n") / BLOCK_ROWS))
    return regression.piecewise(p, "block", "key", "pos")


@query(
    f"""WITH {_POS}, b AS (SELECT *, n // 128 AS block FROM p), f AS (
      SELECT segment, block, coalesce(regr_slope(pos, key), 0) AS a, coalesce(regr_intercept(pos, key), avg(pos)) AS b, min(pos) AS begin_, max(pos) AS end_ FROM b GROUP BY 1, 2)
    SELECT p.segment, p.n, true AS held FROM b p JOIN f USING (segment, block)"""
)
def kv_learned_lookup(spark, sf_dir):
    """Whether each entry stands in the window that its block's learned lines give for its key."""
    return regression.lookups(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", BLOCK_ROWS).withColumnRenamed("l_suppkey", "segment")


@query(
    """WITH {LOG}, l AS (SELECT CAST(k AS DOUBLE) AS h, CAST(seq AS DOUBLE) AS l, 40.0 * seq AS v FROM log),
    s AS (SELECT count(*) AS n, sum(h) AS sh, sum(l) AS sl, sum(v) AS sy, sum(h * h) AS hh, sum(l * l) AS ll, sum(h * l) AS hl, sum(h * v) AS hy, sum(l * v) AS ly FROM l),
    c AS (SELECT *, hh - sh * sh / n AS chh, ll - sl * sl / n AS cll, hl - sh * sl / n AS chl, hy - sh * sy / n AS chy, ly - sl * sy / n AS cly FROM s)
    SELECT 1 AS one, n, round((cll * chy - chl * cly) / (chh * cll - chl * chl), 4) + 0.0 AS a, round((chh * cly - chl * chy) / (chh * cll - chl * chl), 4) + 0.0 AS b,
           CAST(floor(sh / n) AS BIGINT) AS high0, CAST(floor(sl / n) AS BIGINT) AS low0 FROM c"""
)
def kv_plane(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("pos", F.col("seq") * regression.ENTRY_BYTES)
    fit = regression.fit_plane(log.withColumn("high", F.col("k").cast("long")).withColumn("one", F.lit(1)), "one", "high", "seq", "pos")
    return fit.withColumns({"a": F.round("a", 4) + 0.0, "b": F.round("b", 4) + 0.0})


_LE = " || ".join(f"substr({{0}}, {2 * i + 1}, 2)" for i in reversed(range(8)))


@query(
    f"""SELECT event_id, {_LE.format('f')} || {_LE.format('o')} AS pointer, event_id // 360 AS file, 40 * event_id AS place
    FROM (SELECT event_id, lpad(upper(hex(event_id // 360)), 16, '0') AS f, lpad(upper(hex(40 * event_id)), 16, '0') AS o FROM events)"""
)
def kv_pointer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", keys.pointer(F.floor(F.col("event_id") / SEGMENT_ROWS), F.col("event_id") * 40).alias("p"))
    return e.select("event_id", F.hex("p").alias("pointer"), keys.pointer_file(F.col("p")).alias("file"), keys.pointer_offset(F.col("p")).alias("place"))


@query("WITH {LOG} SELECT k, seq, value FROM newest WHERE kind = 1")
def kv_sorted_runs(spark, sf_dir):
    """The newest versions by one pass over key-clustered runs: the first row of each key."""
    runs = merge.sorted_runs(events_log(spark, sf_dir), "k", "seq")
    before = F.lag("k").over(Window.partitionBy("k").orderBy(F.col("seq").desc()))
    return runs.withColumn("before", before).filter("before is null and kind = 1").select("k", "seq", "value")


def _filled_store(spark, sf_dir) -> Store:
    """A store of the events' values by user, put in four batches; users whose newest event is an error are deleted."""
    s = Store.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", Options(l0_trigger=3, segment_rows=2000))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").cast("binary").alias("user_key"), F.col("value").cast("string").cast("binary").alias("value"), "event_id", (F.col("event_type") == "error").alias("deleted"))
    quarter = e.agg(F.max("event_id")).first()[0] // 4 + 1
    for i in range(4):
        s.write_all(e.filter((F.col("event_id") >= i * quarter) & (F.col("event_id") < (i + 1) * quarter)), ["event_id"])
    return s


_STORE = "WITH {LOG} SELECT k, CAST(value AS DOUBLE) AS value FROM newest WHERE kind = 1"


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("k"), F.col("value").cast("string").cast("double").alias("value"))


@query(_STORE)
def kv_store_scan(spark, sf_dir):
    """All visible rows of a store that was written, and compacted on the way, by its own calls."""
    return _read_back(_filled_store(spark, sf_dir).full_scan())


@query(_STORE)
def kv_store_gc(spark, sf_dir):
    """As kv_store_scan, read by another opening after gc."""
    s = _filled_store(spark, sf_dir)
    s.gc()
    return _read_back(Store.open(spark, s.files.root, s.options).full_scan())


@query(_STORE + " AND k BETWEEN '2' AND '4'")
def kv_store_range(spark, sf_dir):
    """A key range by the data source, whose reader leaves files out by the manifest."""
    s = _filled_store(spark, sf_dir)
    kv.register(spark)
    log = spark.read.format("tidelog").option("path", s.files.root).option("low", b"2".hex().upper()).option("high", b"4".hex().upper()).load()
    return _read_back(resolve.scan(log, b"2", b"4"))


@query(None)
def kv_random_keys(spark, sf_dir):
    return workload.random_keys(spark, 1000, 12).join(workload.random_strings(spark, 1000, 12), "op").join(workload.uniform_keys(spark, 1000, 100).withColumnRenamed("key", "uniform"), "op")


@query(None)
def kv_zipf(spark, sf_dir):
    return workload.zipf_keys(spark, 10_000, 100).groupBy("key").agg(F.count(F.lit(1)).alias("ops"))
