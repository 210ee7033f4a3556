"""Removal of long repeated byte strings by bucket-pointer refinement.

Every start of a text has a bucket for the q-gram there.  Buckets are refined by the buckets of later offsets:
the bucket of 2 m bytes is named by those of m bytes at the start and m bytes on, and the new names are used again
at the next step, up to the full length.  Names are 64-bit and the same on all machines, so sorting on them
brings equal strings together anywhere.  Where a name decides on removal it is joined by a second one that is taken
from the string's bytes alone, so strings are told apart by 128 bits.

Only a few starts go through the sort:

1. In each full-length window the half-length gram with the least name is its *anchor*.  Equal windows have equal
   anchors at equal offsets.  An anchor bucket with one member has no repeated window.
2. Neighbouring windows of one anchor form a *run*, itself named by the windows at its ends.  Runs that occur twice
   are repeated as a whole; copies, however many, are settled here.
3. The other runs of buckets with several members are cut into *parts* at fixed offsets from the anchor.  What all
   windows of a part have in common is its *core*; a part with a core of its own has no repeated window, and parts
   that occur twice are repeated as a whole.
4. Of the parts that are left single windows are sorted.

Texts are read three times: for the runs, for the parts, and for the spans that are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BYTE_CODE, STEP, Scratch, blocks, bloom_of, in_bloom, join_groups, mix, text_buffer, trimmed

LENGTH = 400
#: Windows of a part.
PART = 16
#: Strings whose bytes are named at once.
NAMED = 16_384


def _refine(names: np.ndarray, later: int) -> np.ndarray:
    """Names of longer strings, from the names at each start and ``later`` bytes on."""
    with np.errstate(over="ignore"):
        out = names[: len(names) - later] * STEP
        out += names[later:]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def part_of(length: int) -> int:
    return max(1, min(PART, length // 2))


def bucket_names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the strings of half the length, rounded up, of a core's and of ``length`` bytes at each start that has them."""
    half = -(-length // 2)
    names, size = BYTE_CODE[data], 1
    while size * 2 <= half:
        names, size = _refine(names, size), size * 2
    if size < half:
        names, size = _refine(names, half - size), half
    core = length - part_of(length) + 1 - half
    return names, _refine(names, core) if core else names, _refine(names, length - half)


def content_names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes at each place, from nothing but these bytes."""
    windows, out = np.lib.stride_tricks.sliding_window_view(data, length), []
    wide = -(-length // 8) * 8
    with np.errstate(over="ignore"):
        salt = np.arange(1, wide // 8 + 1, dtype=np.uint64) * STEP
        for i in range(0, len(at), NAMED):
            some = np.zeros((len(at[i : i + NAMED]), wide), dtype=np.uint8)
            some[:, :length] = windows[at[i : i + NAMED]]
            out.append(np.add.reduce(mix(some.view(np.uint64) + salt), axis=1))
    return mix(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def between(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Names, by content, of the windows from lo to hi, which overlap, at an offset from what they are sorted by."""
    one = hi == lo
    first = content_names(data, lo, length)
    last = first.copy()
    last[~one] = content_names(data, hi[~one], length)
    with np.errstate(over="ignore"):
        return mix(mix(first + offset.astype(np.uint64)) + last * STEP + (hi - lo).astype(np.uint64))


def runs_of(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, first and last start, anchor name and run name of every run, then the anchors' places, and the names
    of cores and windows at every start."""
    nothing = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return nothing
    half_names, cores, names = bucket_names(data, length)
    low = (half_names & ~np.uint64(0xFFFFFFFF)) | np.arange(len(half_names), dtype=np.uint64)
    width, size = length // 2 + 1, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :]) if size < width else low
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[: len(names)]
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)[: len(names)]
    inside = np.arange(len(names)) + length <= off[1:][doc]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = anchor[lo]
    with np.errstate(over="ignore"):
        name = mix(mix(names[lo] + (at - lo).astype(np.uint64)) + names[hi] * STEP + (hi - lo).astype(np.uint64))
    return doc[lo], lo, hi, mix(half_names[at]), name, at, cores, names


def parts_of(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, cores: np.ndarray, names: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Number of the run, first and last start, core name and part name of each part of the runs."""
    width = part_of(length)
    first, last = (lo - at) // width, (hi - at) // width
    count = last - first + 1
    of = np.repeat(np.arange(len(lo)), count)
    begin = at[of] + (first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * width
    a, b = np.maximum(begin, lo[of]), np.minimum(begin + width - 1, hi[of])
    with np.errstate(over="ignore"):
        core = mix(cores[begin + width - 1] + (begin - at[of]).astype(np.uint64))
        name = mix(mix(names[a] + (a - begin).astype(np.uint64)) + names[b] * STEP + (b - a).astype(np.uint64))
    return of, a, b, core, name


def _mark(text: bytes) -> tuple[int, int]:
    """Two numbers of a text's content: the first half of its SHA-256."""
    digest = hashlib.sha256(text).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


def _blocks(batches, length):
    for batch in batches:
        data, off = text_buffer(batch.column("t"))
        for i, j in blocks(off):
            own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            yield own, at, runs_of(own, at, length)


def _tally(rows: DataFrame, length: int, names) -> DataFrame:
    """(h, x, y, n): counts of the triples that ``names`` gives of a block's runs, combined within tasks."""

    def work(batches):
        held, size = [], 0

        def flush():
            h, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((y, x, h))
            h, x, y = h[order], x[order], y[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            n = np.diff(np.append(at, len(h)))
            for i in range(0, len(at), 50_000):
                j = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[j].view(np.int64)) for c in (h, x, y)), pa.array(n[i : i + 50_000], pa.int64())], ["h", "x", "y", "n"])

        for data, _, runs in _blocks(batches, length):
            held.append(names(data, runs))
            size += len(held[-1][0])
            if size > 500_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return rows.mapInArrow(trimmed(work), "h long, x long, y long, n long").groupBy("h", "x", "y").agg(F.sum("n").alias("n"))


def _both(anchor: np.ndarray, run: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(anchor * STEP + run)


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str, length: int) -> DataFrame:
    """(m, m2, lo, hi): starts lo to hi of repeated windows in the texts of content marks m and m2; spans may repeat or
    overlap."""
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(text).cast("string").alias("t")).filter(F.octet_length("t") >= length)

    def runs_named(data, r):
        _, lo, hi, anchor, run, at, _, _ = r
        return anchor, run, between(data, lo, hi, at - lo, length)

    runs = scratch.cut(_tally(rows, length, runs_named), "runs")
    anchors = scratch.cut(runs.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).filter("n > 1"), "anchors")
    some = share(bloom_of(anchors.select("h"), scratch, "some"))

    def parts(data, r):
        _, lo, hi, anchor, run, at, cores, names = r
        keep = in_bloom(compared.value, _both(anchor, run))
        of, a, b, core, name = parts_of(lo[keep], hi[keep], at[keep], cores, names, length)
        return core, name, between(data, a, b, at[keep][of] - a, length)

    def key(batches):
        for b in batches:
            h, x = (b.column(c).to_numpy().view(np.uint64) for c in "hx")
            yield pa.RecordBatch.from_arrays([pa.array(_both(h, x).view(np.int64)), b.column("n")], ["h", "n"])

    def keyed(tallied: DataFrame, several: DataFrame, name: str) -> DataFrame:
        """(h, n): the names of both levels as one, and their count, where the first has several of the second."""
        return scratch.cut(tallied.join(several, "h", "left_semi").mapInArrow(trimmed(key), "h long, n long"), name)

    keys = keyed(runs.select("h", "x", "n"), anchors.filter("kinds > 1").select("h"), "keys")
    compared = share(bloom_of(keys.select("h"), scratch, "compared"))
    single = share(bloom_of(keys.filter("n = 1").select("h"), scratch, "single"))
    scratch.sweep()
    pieces = scratch.cut(_tally(rows, length, parts), "pieces")
    scratch.sweep()
    cores = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h")
    torn = share(bloom_of(keyed(pieces.select("h", "x", "n"), cores, "torn").select("h"), scratch, "torn"))
    twice = share(bloom_of(pieces.filter("n > 1").select(F.col("x").alias("h")), scratch, "twice"))

    def work(batches):
        done: set = set()
        for data, off, (doc, lo, hi, anchor, run, at, cores, names) in _blocks(batches, length):
            keep = in_bloom(some.value, anchor)
            doc, lo, hi, anchor, run, at = (x[keep] for x in (doc, lo, hi, anchor, run, at))
            marks = np.zeros((len(off), 2), dtype=np.int64)
            fresh = np.zeros(len(off), dtype=bool)
            for d in np.unique(doc).tolist():
                mark = _mark(data[off[d] : off[d + 1]].tobytes())
                marks[d], fresh[d] = mark, mark not in done
                done.add(mark)
            keep = fresh[doc]
            doc, lo, hi, anchor, run, at = (x[keep] for x in (doc, lo, hi, anchor, run, at))
            if not len(doc):
                continue
            start = off[:-1]

            def give(d, a, b, x, y, kind, own):
                for i in range(0, len(d), 100_000):
                    s = slice(i, i + 100_000)
                    n = len(d[s])
                    yield pa.RecordBatch.from_arrays([pa.array(marks[d[s], 0]), pa.array(marks[d[s], 1]), pa.array((a[s] - start[d[s]]).astype(np.int32)), pa.array((b[s] - start[d[s]]).astype(np.int32)), pa.array(x[s].view(np.int64)), pa.array(y[s].view(np.int64)), pa.array(np.full(n, kind, dtype=np.int8)), pa.array(own[s])], _COLUMNS)  # noqa: B023

            both = _both(anchor, run)
            alone = in_bloom(single.value, both)
            yield from give(doc, lo, hi, run, between(data, lo, hi, at - lo, length), 0, np.ones(len(doc), dtype=bool))
            open_ = np.flatnonzero(in_bloom(compared.value, both))
            if not len(open_):
                continue
            of, a, b, core, name = parts_of(lo[open_], hi[open_], at[open_], cores, names, length)
            of = open_[of]
            whole = alone[of] & in_bloom(twice.value, name)
            yield from give(doc[of[whole]], a[whole], b[whole], name[whole], between(data, a[whole], b[whole], at[of[whole]] - a[whole], length), 1, np.ones(whole.sum(), dtype=bool))
            left = in_bloom(torn.value, _both(core, name))
            of, a, b = of[left], a[left], b[left]
            count = b - a + 1
            each = np.repeat(np.arange(len(of)), count)
            place = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            yield from give(doc[of[each]], place, place, names[place], content_names(data, place, length), 2, alone[of[each]])

    found = scratch.cut(rows.mapInArrow(trimmed(work), "m long, m2 long, lo int, hi int, x long, y long, kind byte, own boolean"), "found")
    scratch.sweep()
    spans = ["m", "m2", "lo", "hi"]
    whole = found.filter("kind = 0").join(runs.filter("n > 1").select("x", "y"), ["x", "y"], "left_semi").select(*spans)
    some_parts = found.filter("kind = 1").join(pieces.filter("n > 1").select("x", "y"), ["x", "y"], "left_semi").select(*spans)
    windows = found.filter("kind = 2").select(*spans, "x", "y", "own")
    again = windows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x", "y")
    return whole.unionByName(some_parts).unionByName(windows.filter("own").join(again, ["x", "y"], "left_semi").select(*spans))


_COLUMNS = ["m", "m2", "lo", "hi", "x", "y", "kind", "own"]


def _merge(length: int):
    """Rows (m, m2, lo, hi) sorted by m, m2 and lo to (m, m2, starts, ends) of maximal removed spans."""

    def work(batches):
        mark, starts, ends = None, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([mark[0]], pa.int64()), pa.array([mark[1]], pa.int64()), pa.array([starts], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32()))], ["m", "m2", "starts", "ends"])

        for batch in batches:
            m, m2, lo, hi = (batch.column(c).to_numpy() for c in ("m", "m2", "lo", "hi"))
            if not len(m):
                continue
            edge = np.append(np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (m2[1:] != m2[:-1])])), len(m))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if (int(m[i]), int(m2[i])) != mark:
                    if mark is not None:
                        yield row()
                    mark, starts, ends = (int(m[i]), int(m2[i])), [], []
                reach = np.maximum.accumulate(hi[i:j].astype(np.int64) + length)
                a = lo[i:j].astype(np.int64)
                begin = np.concatenate([[True], a[1:] > reach[:-1]])
                at = np.flatnonzero(begin)
                some, far = a[at].tolist(), reach[np.append(at[1:], j - i) - 1].tolist()
                if ends and some[0] <= ends[-1]:
                    ends[-1] = max(ends[-1], far[0])
                    some, far = some[1:], far[1:]
                    while some and some[0] <= ends[-1]:  # what came before reaches over what follows
                        ends[-1] = max(ends[-1], far[0])
                        some, far = some[1:], far[1:]
                starts += some
                ends += far
        if mark is not None:
            yield row()

    return work


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row for each input row: key, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of a string of ``length`` bytes that starts anywhere else too, in any row.  Null texts count
    as empty; a text shorter than ``length`` stays.  Rows that repeat a text are copies of each other.  An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    spans = repeated_spans(docs, scratch, text, length).repartition("m").sortWithinPartitions("m", "m2", "lo")
    spans = scratch.cut(spans.mapInArrow(trimmed(_merge(length)), "m long, m2 long, starts array<int>, ends array<int>"), "spans")
    scratch.drop("found", "runs", "keys", "anchors", "pieces", "torn")
    scratch.sweep()
    marked = share(bloom_of(spans.select(F.col("m").alias("h")), scratch, "marked"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def pick(batches):
        done: set = set()
        for batch in batches:
            data, off = text_buffer(batch.column("t"))
            m, m2, t = [], [], []
            for i in range(batch.num_rows):
                if off[i + 1] - off[i] >= length:
                    own = data[off[i] : off[i + 1]].tobytes()
                    mark = _mark(own)
                    if mark not in done and in_bloom(marked.value, np.array(mark[:1], dtype=np.int64).view(np.uint64))[0]:
                        done.add(mark)
                        m.append(mark[0])
                        m2.append(mark[1])
                        t.append(own)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(m2, pa.int64()), pa.array(t, pa.binary())], ["m", "m2", "t"])

    # A text that is removed as a whole needs no look at its bytes.
    size = F.octet_length("t")
    texts = rows.select("t").mapInArrow(trimmed(pick), "m long, m2 long, t binary").join(spans, ["m", "m2"])
    entire = (F.size("starts") == 1) & (F.element_at("starts", 1) == 0) & (F.element_at("ends", 1) == size)
    texts = texts.withColumn("t", F.when(entire, F.lit(b"")).otherwise(F.col("t"))).withColumn("entire", entire).dropDuplicates(["m", "m2"])

    def cut(batches):
        for batch in batches:
            removed, sha = [], []
            for t, a, b, entire in zip(*(batch.column(c).to_pylist() for c in ("t", "starts", "ends", "entire")), strict=True):
                removed.append(sum(b) - sum(a))
                kept = b"" if entire else b"".join(t[i:j] for i, j in zip([0, *b], [*a, len(t)], strict=True))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("m2"), pa.array(removed, pa.int64()), pa.array([len(a) for a in batch.column("starts").to_pylist()], pa.int64()), pa.array(sha, pa.string())], ["m", "m2", "removed", "spans", "kept"])

    changed = scratch.cut(texts.mapInArrow(trimmed(cut), "m long, m2 long, removed long, spans long, kept string"), "changed")
    plain = rows.select("k", size.cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    number = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    plain = scratch.cut(plain.withColumns({"m": number(1), "m2": number(17)}), "plain")
    copies = plain.groupBy("m", "m2").agg(F.count(F.lit(1)).alias("rows"))
    out = join_groups(plain, scratch.cut(changed.join(copies, ["m", "m2"]), "counted"), ["m", "m2"], "rows", "k")
    scratch.drop("spans", "changed")
    return out.select(
        F.col("k").alias(key),
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )
