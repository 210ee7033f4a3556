import functools
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, checksum, keys, order, regression


def test_crc32c_known_values():
    assert checksum.crc32c_of([b"123456789", b"", bytes(32)]).tolist() == [0xE3069283, 0, 0x8A9136AA]


def test_crc16_known_values_and_prefix():
    assert checksum.crc16_of([b"123456789", b""]).tolist() == [0x29B1, 0xFFFF]
    start = int(checksum.crc16_of([b"1234"])[0])
    assert checksum.crc16_of([b"56789"], start).tolist() == [0x29B1]


def test_murmur_known_values():
    assert checksum.murmur3_128(b"", 0) == bytes(16)
    assert checksum.murmur3_128(b"hello", 0).hex() == "029bbd41b3a7d8cb191dae486a901e5b"


def test_many_murmur_hashes_at_once():
    data = [bytes(range(n % 251)) * (1 + n % 3) for n in range(120)] + [b""]
    assert [h.tobytes() for h in checksum.murmur3_of(data)] == [checksum.murmur3_128(d) for d in data]
    assert len(checksum.murmur3_of([])) == 0


def test_numbers_have_no_sign(spark):
    some = [0, 1, 255, 256, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(n.to_bytes(8, "little"), str(n)) for n in reversed(some)] + [(b"\x05", "5")], "k binary, n string")
    assert [int(r["n"]) for r in order.NUMERIC.sort(df, "k").collect()] == sorted([*some, 5])


def test_random_strings(spark):
    from tidelog.plans import workload

    one = {r["op"]: bytes(r["key"]) for r in workload.random_keys(spark, 50, 9, 3).collect()}
    two = {r["op"]: bytes(r["key"]) for r in workload.random_keys(spark, 50, 9, 3).repartition(7).collect()}
    assert one == two and len(set(one.values())) > 40 and set(b"".join(one.values())) <= set(bytes.fromhex(workload.KEY_BYTES)) and all(len(k) == 9 for k in one.values())
    assert all(len(r["value"]) == 20 and r["value"].isprintable() for r in workload.random_strings(spark, 20, 20).collect())


def test_udf_nulls(spark):
    rows = spark.createDataFrame([(b"123456789",), (None,)], "v binary")
    assert [tuple(r) for r in rows.select(checksum.crc32c("v"), checksum.crc16("v")).collect()] == [(0xE3069283, 0x29B1), (None, None)]


@pytest.mark.parametrize("double", [False, True])
def test_bloom(double):
    made = bloom.build([b"hello", b"world"], 1024, double)
    assert all(bloom.may_contain(k, made, double) for k in (b"hello", b"world"))
    assert not any(bloom.may_contain(k, made, double) for k in (b"x", b"foo"))
    assert not bloom.may_contain(b"x", b"") and not bloom.may_contain(b"x", bytes(1024), double)


def test_bloom_rate():
    keys_in = [i.to_bytes(4, "little") for i in range(400)]
    made = bloom.build(keys_in, 8192)
    assert all(bloom.may_contain(k, made) for k in keys_in)
    wrong = sum(bloom.may_contain((10**9 + i).to_bytes(4, "little"), made) for i in range(2000))
    assert wrong / 2000 < 0.0125


def test_segment_filters_agree_with_the_scalar_form(spark):
    rows = [(i % 3, f"key{i}".encode()) for i in range(60)]
    made = bloom.segment_filters(spark.createDataFrame(rows, "segment int, user_key binary"), size=256)
    asked = [f"key{i}".encode() for i in range(90)]
    got = {(r[0], bytes(r[1])) for r in bloom.probe_filters(made, spark.createDataFrame([(k,) for k in asked], "user_key binary"), size=256).collect()}
    want = {(s, k) for s in range(3) for k in asked if bloom.may_contain(k, bloom.build([v for t, v in rows if t == s], 256))}
    assert got == want


NUMBERS = [0, 1, 255, 256, 2**32, 2**62]


def test_codecs(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    out = df.select("n", keys.be_key(F.col("n")).alias("be"), keys.le_fixed(F.col("n"), 8).alias("le")).withColumns({"b": keys.be_number(F.col("be")), "l": keys.le_number(F.col("le"), 8)}).collect()
    for r in out:
        assert bytes(r["be"]) == r["n"].to_bytes(8, "big") and bytes(r["le"]) == r["n"].to_bytes(8, "little") and r["b"] == r["l"] == r["n"]
    for width in (1, 2, 4):
        got = [bytes(r[0]) for r in df.select(keys.le_fixed(F.col("n"), width)).collect()]
        assert got == [(n % 256**width).to_bytes(width, "little") for n in NUMBERS]
    p = keys.internal_key(F.lit(b"ab"), F.lit(7).cast("long"), F.lit(1))
    row = spark.range(1).select(p.alias("p")).select("p", keys.internal_user_key(F.col("p")), keys.internal_seq(F.col("p")), keys.internal_kind(F.col("p"))).first()
    assert bytes(row[0]) == b"ab" + (7 << 8 | 1).to_bytes(8, "little") and (bytes(row[1]), row[2], row[3]) == (b"ab", 7, 1)


def test_byte_order(spark):
    values = [b"", b"a", b"ab", b"\x7f", b"\x80", b"\xff", b"a\x00"]
    got = [bytes(r[0]) for r in order.BYTEWISE.sort(spark.createDataFrame([(v,) for v in values], "k binary"), "k").collect()]
    assert got == sorted(values)
    numbers = [n.to_bytes(8, "little") for n in (5, 256, 3)]
    got = [int.from_bytes(bytes(r[0]), "little") for r in order.NUMERIC.sort(spark.createDataFrame([(v,) for v in numbers], "k binary"), "k").collect()]
    assert got == [3, 5, 256]
    row = spark.createDataFrame([(numbers[0], numbers[1], numbers[2])], "a binary, b binary, c binary").select(order.NUMERIC.least(F.col("a"), F.col("b"), F.col("c")), order.NUMERIC.greatest(F.col("a"), F.col("b"), F.col("c"))).first()
    assert [int.from_bytes(bytes(x), "little") for x in row] == [3, 256]


def test_separators(spark):
    cases = [(b"abc1", b"abc9", b"abc2"), (b"abc1", b"abc2", b"abc1"), (b"ab", b"abc", b"ab"), (b"a\xff", b"b", b"a\xff"), (b"", b"b", b""), (b"ax", b"cx", b"b")]
    df = spark.createDataFrame([c[:2] for c in cases], "a binary, b binary")
    got = [bytes(r[0]) for r in df.select(order.shortest_separator(F.col("a"), F.col("b"))).collect()]
    assert got == [c[2] for c in cases]
    cases = [(b"abc", b"b"), (b"\xff\x01z", b"\xff\x02"), (b"\xff\xff", b"\xff\xff"), (b"", b"")]
    got = [bytes(r[0]) for r in spark.createDataFrame([c[:1] for c in cases], "a binary").select(order.short_successor(F.col("a"))).collect()]
    assert got == [c[1] for c in cases]


def test_lines():
    x = list(range(300))
    y = [40 * i if i < 150 else 4000 * i for i in x]
    parts = regression.greedy_segments(x, y)
    assert sum(p[4] for p in parts) == 300 and len(parts) > 1
    for first, last, slope, intercept, _ in parts:
        assert all(abs(y[i] - slope * i - intercept) < 81 for i in range(int(first), int(last) + 1))
    assert regression.greedy_segments([1], [5]) == [(1.0, 1.0, 0.0, 5.0, 1)]
    assert regression.greedy_segments([], []) == []
    assert regression.greedy_segments([2, 2, 2], [1, 2, 3]) == [(2.0, 2.0, 0.0, 2.0, 3)]


def test_search_window_holds_the_entry(spark):
    rows = [(s, k, 40 * i) for s in range(3) for i, k in enumerate(sorted({(s + 2) * j * j % 9973 for j in range(100)}))]
    log = spark.createDataFrame(rows, "segment int, key long, pos long")
    models = regression.piecewise(log, "segment", "key", "pos")
    blocks = log.groupBy("segment").agg(F.min("pos").alias("begin"), F.max("pos").alias("end"))
    window = regression.search_window(models, log.select("segment", "key"), blocks, "segment", "key")
    bad = log.join(window, ["segment", "key"]).filter("pos < low or pos >= high + 40")
    assert bad.count() == 0 and window.count() == len(rows)


def blocks_of_points(rng, groups):
    sizes = rng.integers(1, 129, groups)
    x = np.concatenate([np.sort(rng.integers(0, rng.choice([3, 200, 10**6]), n)) for n in sizes]).astype(float)
    y = np.concatenate([40.0 * np.arange(n) for n in sizes]) + np.repeat(rng.integers(0, 9, groups) * 5120.0, sizes)
    return np.cumsum(sizes) - sizes, sizes, x, y


def test_groups_that_advance_together_get_the_same_lines():
    starts, sizes, x, y = blocks_of_points(np.random.default_rng(3), 300)
    one = [(g, *line) for g, (s, n) in enumerate(zip(starts, sizes)) for line in regression.greedy_segments(x[s : s + n], y[s : s + n])]
    assert list(zip(*(c.tolist() for c in regression.greedy_groups(starts, x, y)))) == one and len(one) > 600
    assert len(regression.greedy_groups([], [], [])[0]) == 0


def test_lines_of_a_million_points_take_seconds():
    starts, _, x, y = blocks_of_points(np.random.default_rng(4), 15_000)
    began = time.process_time()
    regression.greedy_groups(starts, x, y)
    assert len(x) > 900_000 and time.process_time() - began < 10  # one at a time a tenth of them took 3 seconds


@pytest.mark.parametrize("rows_at_once", [1 << 17, 200])
def test_lookups_are_those_of_the_search_window(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(regression, "_ROWS", rows_at_once)
    rng = np.random.default_rng(5)
    some = [(int(s), int(k)) for s, n in enumerate([1, 127, 128, 129, 700, 1500]) for k in rng.integers(0, [9, 10**6][s % 2], n)]
    log = spark.createDataFrame(some, "segment long, key long")
    w = Window.partitionBy("segment").orderBy("key")
    p = log.withColumn("n", F.row_number().over(w) - 1).withColumns({"block": F.col("segment") * 1000 + F.floor(F.col("n") / 128), "pos": F.col("n") * 40})
    p = p.localCheckpoint()
    bounds = p.groupBy("block").agg(F.min("pos").alias("begin"), F.max("pos").alias("end"))
    window = regression.search_window(regression.piecewise(p, "block", "key", "pos"), p.select("block", "key").distinct(), bounds, "block", "key")
    want = p.join(window, ["block", "key"]).select("segment", "n", ((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high") + 40)).alias("held"))
    want = sorted(map(tuple, want.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = sorted(map(tuple, regression.lookups(log, "segment", "key", 128).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == len(some)


def test_lookups_keep_entries_without_a_key(spark):
    log = spark.createDataFrame([(1, None)] * 130 + [(1, k) for k in range(9)] + [(2, None), (None, 4)], "segment long, key long")
    got = sorted(map(tuple, regression.lookups(log, "segment", "key", 128).collect()))
    assert got == [(1, n, True) for n in range(139)] + [(2, 0, True)]


def test_windows_do_not_hold_every_place():
    x = np.arange(128.0)
    starts, pos = np.array([0]), 40 * np.arange(128)
    of, _, _, slope, intercept, _ = regression.greedy_groups(starts, x, pos)
    held = regression.in_window(np.zeros(128, dtype=int), x, pos[::-1], pos[:1], pos[-1:], (of, slope, intercept))
    assert held[60:68].any() and not held[0] and not held[127]


def test_plane(spark):
    rows = [(1, h, l, 3.0 * h + 2 * l) for h in range(10) for l in range(10)]
    r = regression.fit_plane(spark.createDataFrame(rows, "g int, h long, l long, y double"), "g", "h", "l", "y").first()
    assert (round(r["a"], 6), round(r["b"], 6), r["n"]) == (3.0, 2.0, 100)


def test_user_defined_order(spark):
    backwards = order.Comparator("backwards", lambda k: [F.reverse(k.cast("string"))])
    got = [r[0] for r in backwards.sort(spark.createDataFrame([("ab",), ("ba",), ("cc",)], "k string"), "k").collect()]
    assert backwards.name == "backwards" and got == sorted(["ab", "ba", "cc"], key=lambda s: s[::-1])
    assert functools.reduce(lambda a, b: a and b, [order.BYTEWISE.name == "bytewise", order.NUMERIC.name == "numeric"])
