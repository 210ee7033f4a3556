import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import compaction, merge, resolve
from tidelog.plans import manifest
from tidelog.plans.store import Store
from tidelog.schema import Options, Status, StoreError


def key(i: int) -> bytes:
    return i.to_bytes(8, "big")


def rows(df):
    return [(bytes(r[0]), bytes(r[1])) for r in df.collect()]


def test_single_key(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    assert s.get_string(key(1)) == b"" and rows(s.scan(b"", b"\xff")) == []
    assert s.put(key(1), b"SE").ok and s.get_string(key(1)) == b"SE"
    assert s.delete(key(1)).ok and s.get_string(key(1)) == b"" and s.delete(key(1)) is Status.NOT_FOUND


def test_empty_value_is_found(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(b"", b"")
    s.put(b"a\x00", b"x")
    s.flush()
    assert s.get(b"") == (Status.OK, b"") and s.get_string(b"") == b"" and s.get(b"zz")[0] is Status.NOT_FOUND
    assert rows(s.full_scan()) == [(b"", b""), (b"a\x00", b"x")]


def test_batches_scan_and_reopen(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    n = 64
    s.put_all(spark.createDataFrame([(key(i), b"s" * (i % 7 + 1)) for i in range(n)], "user_key binary, value binary"))
    want = [(key(i), b"s" * (i % 7 + 1)) for i in range(n)]
    assert rows(s.scan(key(0), key(n // 2 - 1))) == want[: n // 2]
    assert rows(s.scan_parallel(key(5), key(5))) == want[5:6] and rows(s.scan(key(9), key(3))) == []
    report = s.delete_all(spark.createDataFrame([(key(i),) for i in (*range(0, n, 2), n + 5)], "user_key binary"))
    assert report.filter("deleted").count() == n // 2 and report.filter("not deleted").count() == 1
    again = Store.open(spark, path)
    assert again.last_seq == s.last_seq == n + n // 2
    assert rows(again.full_scan()) == want[1::2]
    again.put_all(spark.createDataFrame([(key(0), b"new")], "user_key binary, value binary"))
    assert again.get(key(0)) == (Status.OK, b"new") and again.get(key(0), as_of=n - 1) == (Status.OK, b"s")
    assert again.check() == []


def test_put_delete_put_survives_compaction(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=100))
    for value in (b"1", b"2"):
        s.put(b"k", value)
        s.flush()
    s.delete(b"k")
    s.flush()
    s.put(b"k", b"3")
    s.flush()
    s.options.l0_trigger = 2
    assert s.compact() == 1 and set(s.level_files()) == {1}
    assert s.get(b"k") == (Status.OK, b"3") and s.log().count() == 4
    assert s.gc().ok and s.log().count() == 1 and s.get(b"k") == (Status.OK, b"3")


def test_expiry(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    for i in range(4):
        s.put(key(i), b"v")
    assert s.expire_at(99) is Status.CORRUPTION and s.expire_at(1).ok and s.expire_at(0).ok
    assert s.get(key(1)) == (Status.EXPIRED, None) and s.get(key(2))[0].ok
    assert [k for k, _ in rows(s.full_scan())] == [key(2), key(3)]
    # The last number is accepted; the next write is then expired at once.
    assert s.expire_at(s.last_seq).ok
    s.put(key(9), b"v")
    assert s.get(key(9))[0] is Status.EXPIRED
    s.delete(key(2))
    s.reset()
    assert s.last_seq == 0 and s.state["live_seq"] == 0 and s.full_scan().count() == 0 and s.approximate_size() == 0
    s.put(key(2), b"w")
    assert s.get(key(2)) == (Status.OK, b"w")


def test_fixed_length(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(fixed_key_length=8))
    with pytest.raises(StoreError):
        s.put(b"short", b"")
    s.put(key(1), b"x")
    assert s.get(key(1))[0].ok


def test_other_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = Store.open(spark, path), Store.open(spark, path)
    one.put(b"a", b"1")
    one.flush()
    two.put(b"b", b"2")
    with pytest.raises(StoreError):
        two.flush()
    assert manifest.load(one.files)["version"] == one.state["version"]


def test_multi_get_statuses(spark):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 5, 1, "y"), ("b", 2, 1, "z"), ("b", 6, 0, None), ("c", 3, 1, "w")], "user_key string, seq long, kind int, value string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "user_key string")
    got = {r[0]: (r[1], r[2]) for r in resolve.multi_get(log, asked, live=4).collect()}
    assert got == {"a": ("OK", "y"), "b": ("NOT_FOUND", None), "c": ("EXPIRED", None), "d": ("NOT_FOUND", None)}


def test_policy():
    assert [compaction.picked(0, n) for n in (0, 3, 4, 7)] == [0, 0, 4, 7]
    assert [compaction.picked(1, n) for n in (9, 10, 11, 14)] == [0, 2, 3, 6]


def test_trivial_move():
    o = Options(fanout=1)
    seg = lambda i, level, a, b: {"id": i, "level": level, "min_key": a, "max_key": b}
    assert compaction.plan([seg(1, 1, "01", "02"), seg(2, 2, "05", "06")], 1, o)[2] == "move"
    assert compaction.plan([seg(1, 1, "01", "05"), seg(2, 2, "05", "06")], 1, o)[2] == "merge"
    assert compaction.plan([seg(1, 2, "01", "02")], 2, o)[2] == "merge"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_against_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    path = str(tmp_path / "s")
    s = Store.open(spark, path, Options(l0_trigger=3, fanout=2, bloom=False))
    model, seq, live = {}, 0, 0
    for _ in range(60):
        k, what = key(rng.randrange(12)), rng.random()
        if what < 0.5:
            v = bytes([rng.randrange(256)]) * rng.randrange(4)
            s.put(k, v)
            model[k] = (seq, v)
            seq += 1
        elif what < 0.65:
            there = k in model and model[k][0] >= live
            assert s.delete(k) is (Status.OK if there else Status.NOT_FOUND)
            if there:
                model[k] = (seq, None)
                del model[k]
                seq += 1
        elif what < 0.75:
            s.flush()
        elif what < 0.8 and seq:
            at = rng.randrange(seq)
            s.expire_at(at)
            live = max(live, at + 1)
        elif what < 0.83:
            s.gc()
        elif what < 0.88:
            s.flush()
            s = Store.open(spark, path, s.options)
            assert s.last_seq == seq
    want = sorted((k, v) for k, (q, v) in model.items() if q >= live)
    assert rows(s.full_scan()) == want
    s.flush()
    s.compact()
    assert rows(s.full_scan()) == want and s.check() == []
    low, high = key(3), key(8)
    assert rows(s.scan(low, high)) == [x for x in want if low <= x[0] <= high]


def test_filters_find_every_key(spark, tmp_path):
    from tidelog.functions import bloom

    s = Store.open(spark, str(tmp_path / "s"))
    for i in range(20):
        s.put(key(i), b"v")
    s.flush()
    got = bloom.probe_filters(s.filters(512), spark.createDataFrame([(key(i),) for i in range(20)], "user_key binary"), size=512)
    assert got.select("user_key").distinct().count() == 20


def test_stream_and_source(spark, tmp_path):
    from tidelog.sources import kv
    from tidelog.streaming import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([(key(i), b"v", i == 3) for i in range(6)], "user_key binary, value binary, deleted boolean").write.parquet(src)
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(key(3), b"old")
    stream = spark.readStream.schema("user_key binary, value binary, deleted boolean").parquet(src)
    for _ in range(2):  # nothing is taken twice
        ingest.write_stream(stream, s, str(tmp_path / "ck")).awaitTermination(120)
    assert [k for k, _ in rows(s.full_scan())] == [key(i) for i in (0, 1, 2, 4, 5)]
    kv.register(spark)
    log = spark.read.format("tidelog").option("path", s.files.root).load()
    assert log.count() == s.log().count() == 7
    assert kv.read(spark, s.files.root).count() == 5 and kv.read(spark, s.files.root, "history").filter("rn = 2").count() == 1
    few = spark.read.format("tidelog").option("path", s.files.root).option("low", key(4).hex().upper()).load()
    assert resolve.visible(few).count() >= 2


def test_numbers_are_dense_in_wide_tables(spark):
    rows_ = spark.range(1_000_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.xxhash64("id").alias("h"))
    out = merge.number_rows(rows_, 7, ["h"])
    for columns in (["seq"], ["seq", "wide"]):
        x = out.select(*columns).agg(F.count("seq"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
        assert tuple(x) == (1_000_000, 1_000_000, 7, 1_000_006)


def test_equal_parts_are_ntiles(spark):
    from pyspark.sql import Window

    for n, parts in ((0, 3), (2, 5), (23, 5), (40, 8)):
        df = spark.range(n).withColumn("h", F.xxhash64("id"))
        got = {(r["id"], r["part"]) for r in merge.equal_parts(df, parts, ["h"]).collect()}
        assert got == {(r["id"], r["p"]) for r in df.withColumn("p", F.ntile(parts).over(Window.orderBy("h"))).collect()}


def batch_of(spark, numbers, value=b"v"):
    return spark.createDataFrame([(key(i), value) for i in numbers], "user_key binary, value binary")


def test_readers_keep_their_files_until_gc(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=3, retain_seconds=3600))
    for i in range(2):
        s.put_all(batch_of(spark, range(i, i + 4)))
    early = s.full_scan()
    s.put_all(batch_of(spark, [9]))  # compacts
    assert set(s.level_files()) == {1} and early.count() == 5
    s.gc()
    assert early.count() == 5 and s.full_scan().count() == 6
    s.options.retain_seconds = 0
    s.gc()
    assert len([n for n in s.files.names("") if n.startswith("seg-")]) == 1 and s.full_scan().count() == 6 and s.check() == []


def test_manifests_are_ordered_by_number(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.state = s.state | {"version": 999_998}
    for i in range(3):
        s.put_all(batch_of(spark, [i]))
    again = Store.open(spark, s.files.root)
    assert again.state["version"] == 1_000_001 and again.full_scan().count() == 3


def test_single_puts_outlive_the_driver(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(b"a", b"1")
    s.flush()
    s.put(b"a", b"2")
    s.put(b"b", b"")
    s.delete(b"a")
    again = Store.open(spark, s.files.root)  # the first was never closed
    assert again.last_seq == 4 and again.memory_contains(b"b") and again.memory_size() > 0
    assert rows(again.full_scan()) == [(b"b", b"")]
    again.flush()
    assert not again.files.names("log") and rows(Store.open(spark, s.files.root).full_scan()) == [(b"b", b"")]


def test_merges_write_several_segments(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=2, segment_rows=100))
    for i in range(2):
        s.put_all(batch_of(spark, range(i * 50, 300 + i * 50)))
    made = s.state["segments"]
    assert len(made) > 3 and {x["level"] for x in made} == {1} and len({x["id"] for x in made}) == len(made)
    spans = sorted((x["min_key"], x["max_key"]) for x in made)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and s.full_scan().count() == 350 and s.check() == []


def test_a_merge_has_fewer_tasks_than_segments(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=2, segment_rows=10, fanout=1000))
    for i in range(2):
        s.put_all(batch_of(spark, range(i * 50, 300 + i * 50), str(i).encode()))
    made = s.state["segments"]
    folder = made[0]["path"].split("/")[0]
    tasks = {n.split("-")[1] for part in s.files.names(folder) if part.startswith("part=") for n in s.files.names(f"{folder}/{part}") if n.startswith("part-")}
    assert 50 <= len(made) <= 64 and len(tasks) <= spark.sparkContext.defaultParallelism
    assert {x["level"] for x in made} == {1} and sum(x["rows"] for x in made) == 600 and s.check() == []
    spans = sorted((x["min_key"], x["max_key"]) for x in made)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert [x["min_key"] for x in made] == [a for a, _ in spans] and len({x["id"] for x in made}) == len(made)
    assert s.state["next_segment"] > max(x["id"] for x in made)
    assert rows(s.full_scan()) == [(key(i), b"0" if i < 50 else b"1") for i in range(350)]


def test_gc_cuts_segments_by_the_rows_that_stay(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=99, segment_rows=50))
    for i in range(6):
        s.put_all(batch_of(spark, range(100), str(i).encode()))
    s.gc()
    again = Store.open(spark, s.files.root, s.options)
    assert len(again.state["segments"]) <= 2 + spark.sparkContext.defaultParallelism and again.check() == []
    assert rows(again.full_scan()) == [(key(i), b"5") for i in range(100)]


def test_cut_runs_keep_keys_whole_and_move_no_rows(spark):
    log = spark.createDataFrame([(k, i) for k, n in enumerate([1, 9, 25, 1, 1, 30, 2]) for i in range(n)], "user_key int, seq long")
    cut = merge.cut_runs(merge.sorted_runs(log, partitions=1), 10, 7)
    assert cut._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = [tuple(r) for r in cut.select("user_key", "part").distinct().orderBy("user_key").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)] and cut.count() == 69


def test_old_segments_go_whole_and_young_ones_stay(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(l0_trigger=99, segment_rows=10, retain_seconds=3600))
    for i in range(2):
        s.put_all(batch_of(spark, range(30)))
    s.gc()
    folders = lambda: [n for n in s.files.names("") if n.startswith("seg-")]
    assert len(folders()) == 3
    s.files.age = lambda name: 4000.0
    s.gc()
    assert {x["path"].split("/")[0] for x in s.state["segments"]} == set(folders()) and s.full_scan().count() == 30 and s.check() == []


def test_damage_is_found(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put_all(batch_of(spark, range(5)))
    s.state["segments"][0]["check"] ^= 1
    assert s.check() == [s.state["segments"][0]["path"]]


def test_stream_batches_are_committed_with_their_numbers(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([(b"k", b"1", 1, False), (b"k", None, 2, True), (b"k", b"3", 3, False), (b"l", b"1", 1, False), (b"l", None, 2, True)], "user_key binary, value binary, at int, deleted boolean")
    s.write_all(batch, ["at"], ("events", 4))
    assert rows(s.full_scan()) == [(b"k", b"3")] and Store.open(spark, s.files.root).state["streams"] == {"events": 4}
    s.write_all(batch.limit(0), ["at"], ("events", 5))
    assert manifest.load(s.files)["streams"] == {"events": 5}


def test_compaction_changes_no_answer(spark):
    rng = random.Random(5)
    log = spark.createDataFrame([(f"k{rng.randrange(9)}", i, rng.randrange(2), str(i)) for i in range(80)], "user_key string, seq long, kind int, value string")
    for live in (0, 30, 79):
        one = sorted(map(tuple, resolve.visible(log, live=live).collect()))
        assert one == sorted(map(tuple, resolve.visible(compaction.drop_expired(log, live), live=live).collect()))
        assert one == sorted(map(tuple, compaction.collapse(log, live, bottom=True).collect()))
    assert log.filter(F.col("seq") < 0).count() == 0
