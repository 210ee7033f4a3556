"""N-gram Jaccard join: exact set-similarity join of documents' word shingles, and its components.

Index lists hold the prefix shingles of each set under one global order: shingles that many sets have come
last, the rest by hash.  Lists are read in blocks by size and position, and a block is skipped where no pair
with it can reach the threshold.  What is left needs no row for each pair:

* equal sets are one class, of which one set is joined;
* an entry carries a small signature of its set; two entries of a list that look alike are one *family* at once, by
  union-find within the task, and only joining edges leave it.  Pairs that don't look alike are counted by the
  prefix shingles that they share, and joined where count and positions leave a link possible;
* entries of a list that one map task holds are combined before they are sent, so a shingle that a third of all sets
  have reaches its list as a few entries of each task; blocks of a long list that can't be excluded are joined whole;
* families are compared in tiles of a bounded number of shingles.  A set's intersections with a whole tile are derived
  from those of a similar set already answered: only the shingles that one has and the other lacks are looked up.
  A tile whose members are connected is left at once.  A family of several tiles is first connected tile by tile,
  each with the family's pilots; then only members outside of its main component meet the other tiles.

Tasks emit links that join components, at most one less than they hold sets.  Shingles are compared by 64-bit hashes,
sets are equal when 128 bits of their content are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import STEP, Scratch, blocks, bloom_of, grams, in_bloom, join_groups, mix, text_buffer, word_hashes, trimmed
from tidelog.llm.components import components

#: Shingles of more sets than this come last in the order; of more than ``HOT_MOST`` shingles only the commonest do.
HOT, HOT_MOST = 64, 20_000_000
#: Counts are taken of shingles whose hash is in the first quarter, which come first in the order.
COUNTED = 1 << 62
#: Entries of lists up to so many are compared all at once; entries of a block of a longer list; entries from which on
#: a list's blocks are joined as a whole.
SHORT_LIST, LIST_BLOCK, FINE_LIST = 16, 64, 128
#: A map task combines the entries of a list from this number on.
COMBINE = 32
#: Shingles that are counted, and entries that are combined, at once.
HELD_SHINGLES, HELD_ENTRIES = 1_000_000, 250_000
#: Shingles of a tile: 8 MiB.  About so many sets of a family are its pilots.
TILE_SHINGLES, PILOTS = 1 << 20, 64
#: Sets of a tile whose intersections with all others are kept for deriving those of others.
ANSWERED = 8
_TOP = np.uint64(1 << 63)
#: Words of a signature, 64 bits each; a byte for each bin of hashes.
SIGNATURE = 2


class Rule:
    """100 * intersection >= percent * union, of shingles of ``words`` words."""

    def __init__(self, words: int = 4, percent: int = 85):
        self.words, self.percent = words, percent
        # Bounds travel to the workers with the rule.
        self.short_list, self.list_block, self.fine_list, self.combine, self.answered = SHORT_LIST, LIST_BLOCK, FINE_LIST, COMBINE, ANSWERED

    def needed(self, n, m):
        """Least intersection of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1

    def smallest(self, n):
        """Least size of a set that a set of size n can be linked with."""
        return -(-self.percent * n // 100)

    def shared(self, n, m):
        """Least number of shingles in both prefixes of linked sets, the larger of size m."""
        return self.needed(n, m) - self.smallest(m) + 1


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    n = len(off) - 1
    w, doc = word_hashes(data, off)
    h, of = grams(w, doc, words)
    h = h >> np.uint64(1)  # the top bit orders
    count = np.bincount(doc, minlength=n)
    bounds, word_at = np.searchsorted(of, np.arange(n + 1)), np.concatenate([[0], np.cumsum(count)])
    out = []
    for d in range(n):
        if 0 < count[d] < words:
            own = w[word_at[d] : word_at[d + 1]]
            one = np.array([count[d]], dtype=np.uint64)
            for x in own:
                one = mix(one + x)
            out.append(one >> np.uint64(1))
        else:
            s = np.sort(h[bounds[d] : bounds[d + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """Two numbers for equal sets."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0), STEP):
            out.append(int(mix(np.array([np.add.reduce(mix(s + salt)) + np.uint64(len(s))], dtype=np.uint64))[0].view(np.int64)))
    return out[0], out[1]


def _sets(batches, words):
    for batch in batches:
        data, off = text_buffer(batch.column("t"))
        for i, j in blocks(off):
            yield batch.slice(i, j - i), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)


def _hot_shingles(rows: DataFrame, rule: Rule, scratch: Scratch) -> np.ndarray:
    def count(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000], pa.int32())], ["h", "n"])

        for _, sets in _sets(batches, rule.words):
            held += [s[: np.searchsorted(s, np.uint64(COUNTED >> 1))] for s in sets]
            size += sum(map(len, held[-len(sets) :])) if sets else 0
            if size > HELD_SHINGLES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    hot = rows.select("t").mapInArrow(trimmed(count), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
    hot = scratch.cut(hot, "hot")
    # Of many hot shingles the filter takes the commonest, so that it stays sparse: a row for each power of two.
    level = F.floor(F.log2("n"))
    least, held = None, 0
    for row in sorted(hot.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += row["n"]
        if least is not None and held > HOT_MOST:
            break
        least = row["level"]
    chosen = hot if least is None else hot.filter(level >= least)
    return bloom_of(chosen.select("h"), scratch, "hot")


_SIGN = [f"w{i}" for i in range(SIGNATURE)]
_BINS = np.arange(8 * SIGNATURE, dtype=np.uint64) << np.uint64(63 - (8 * SIGNATURE).bit_length() + 1)


def signature(s: np.ndarray) -> np.ndarray:
    """A byte for the least hash in each bin, 0 for an empty bin; alike sets have many bytes in common."""
    at = np.searchsorted(s, _BINS)
    full = np.diff(np.append(at, len(s))) > 0
    byte = (mix(s[np.minimum(at, len(s) - 1)]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return np.where(full, byte, np.uint8(0)).astype(np.uint8).view(np.int64)


def alike(a: dict, b: dict) -> np.ndarray:
    """Whether half of the bins that either has agree.  Only the amount of work rests on this."""
    same = used = 0
    for i in range(SIGNATURE):
        x, y = (np.ascontiguousarray(np.atleast_1d(e[f"w{i}"])) for e in (a, b))
        x, y = np.broadcast_arrays(x, y)
        x, y = (np.ascontiguousarray(z).view(np.uint8).reshape(-1, 8) for z in (x, y))
        same = same + ((x == y) & (x > 0)).sum(1)
        used = used + ((x > 0) | (y > 0)).sum(1)
    return 2 * same >= used


def _profiles(rows: DataFrame, rule: Rule, hot) -> DataFrame:
    """k, h, n, c and d (class), the prefix and the signature w0.. of each row."""

    def work(batches):
        for part, sets in _sets(batches, rule.words):
            n, c, d, prefix, sign = [], [], [], [], []
            for s in sets:
                n.append(len(s))
                if not len(s):
                    c.append(None)
                    d.append(None)
                    prefix.append(None)
                    sign.append([0] * SIGNATURE)
                    continue
                one, two = class_key(s)
                c.append(one)
                d.append(two)
                ordered = np.sort(s | np.where(in_bloom(hot.value, s), _TOP, np.uint64(0)))
                prefix.append(ordered[: rule.prefix(len(s))].view(np.int64))
                sign.append(signature(s))
            cols = [part.column("k"), part.column("h"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([int(x[i]) for x in sign], pa.int64()) for i in range(SIGNATURE))], ["k", "h", "n", "c", "d", "prefix", *_SIGN])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(trimmed(work), f"k {kind}, h long, n long, c long, d long, prefix array<long>, " + ", ".join(f"{w} long" for w in _SIGN))


def _class_sets(rows: DataFrame, rule: Rule, needed) -> DataFrame:
    """(c, d, s): the sets of needed classes, and of few others that the filter lets through."""

    def work(batches):
        done: set = set()
        for _, sets in _sets(batches, rule.words):
            keys = [class_key(s) if len(s) else (0, 0) for s in sets]
            take = in_bloom(needed.value, np.array([k[0] for k in keys], dtype=np.int64).view(np.uint64))
            c, d, b = [], [], []
            for i in np.flatnonzero(take):
                if len(sets[i]) and keys[i] not in done:
                    done.add(keys[i])
                    c.append(keys[i][0])
                    d.append(keys[i][1])
                    b.append(sets[i].tobytes())
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(b, pa.binary())], ["c", "d", "s"])

    return rows.select("t").mapInArrow(trimmed(work), "c long, d long, s binary").dropDuplicates(["c", "d"])


# ---------------------------------------------------------------- families


class Entries:
    """Entries of index lists as columns: token, sizes from lo to hi, the farthest position, the largest rest behind a
    position, the sets that it stands for, the number of the set (that of a block's head) and signature words.  A block
    stands for sets that are one family already."""

    NAMES = ("t", "lo", "hi", "far", "rest", "sets", "id", *_SIGN)

    def __init__(self, columns: dict):
        self.c = columns

    def __len__(self):
        return len(self.c["t"])

    def take(self, i) -> Entries:
        return Entries({k: v[i] for k, v in self.c.items()})

    @classmethod
    def joined(cls, parts: list) -> Entries:
        return cls({k: np.concatenate([p.c[k] for p in parts]) for k in cls.NAMES})

    def block(self, group: np.ndarray) -> Entries:
        """One entry for each group of entries of one list, groups being numbered from 0."""
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.diff(np.concatenate([[-1], group[order]])))
        c = {k: v[order] for k, v in self.c.items()}
        out = {k: c[k][at] for k in ("t", "id", *_SIGN)} | {"lo": np.minimum.reduceat(c["lo"], at), "sets": np.add.reduceat(c["sets"], at)}
        return Entries(out | {k: np.maximum.reduceat(c[k], at) for k in ("hi", "far", "rest")})


def may_link(a: dict, b: dict, rule: Rule) -> np.ndarray:
    """Whether sets of two entries can be linked that share the shingles at these positions: before them they share no
    more than the smaller position, from them on no more than the smaller rest."""
    ok = (a["hi"] >= rule.smallest(b["lo"])) & (b["hi"] >= rule.smallest(a["lo"]))
    return ok & (np.minimum(a["far"], b["far"]) + np.minimum(a["rest"], b["rest"]) >= rule.needed(a["lo"], b["lo"]))


class Families:
    """Union-find of set numbers.  ``edges`` has what joined two of them, ``met`` the pairs that are to be counted."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self.met: list[list[np.ndarray]] = []

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def labels(self, ids: np.ndarray) -> np.ndarray:
        return np.array([self.top(x) for x in ids.tolist()], dtype=np.int64)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            self.join(x, y)

    def meet(self, a: dict, b: dict) -> None:
        """Entries that may be linked: joined if they are alike or blocks, else to be counted."""
        now = alike(a, b) | (a["sets"] > 1) | (b["sets"] > 1)
        self.join_all(a["id"][now], b["id"][now])
        if not now.all():
            later = ~now
            self.met.append([x[k][later] for k in ("id", "lo", "far") for x in (a, b)])


def short_lists(e: Entries, rule: Rule, families: Families) -> None:
    """Compare the entries of many short lists, which follow each other."""
    t = e.c["t"]
    for d in range(1, min(rule.short_list, len(t))):
        i = np.flatnonzero(t[:-d] == t[d:])
        if not len(i):
            break
        a, b = e.take(i).c, e.take(i + d).c
        ok = np.flatnonzero(may_link(a, b, rule))
        families.meet({k: v[ok] for k, v in a.items()}, {k: v[ok] for k, v in b.items()})


class LongList:
    """A list that is read in blocks sorted by size.

    Of a block before, and of the block with itself, first the summaries are tested; it is skipped if these exclude all
    pairs, or if all entries are one family.  Of the first ``rule.fine_list`` entries each pair of different families is
    tested; the rest of a longer list, which stands for a common shingle, is joined block by block.
    """

    def __init__(self, rule: Rule, families: Families):
        self.rule, self.families, self.before, self.entries = rule, families, [], 0

    def add(self, e: Entries) -> None:
        rule, families = self.rule, self.families
        whole = {k: v[0] for k, v in e.block(np.zeros(len(e), dtype=np.int64)).c.items()}
        self.before = [(b, w) for b, w in self.before if w["hi"] >= rule.smallest(whole["lo"])]
        self.entries += len(e)
        coarse = self.entries > rule.fine_list
        two = families.labels(e.c["id"])
        for b, w in [*self.before, (e, whole)]:
            if not may_link(w, whole, rule):
                continue
            one = families.labels(b.c["id"])
            if (one == one[0]).all() and (two == one[0]).all():
                continue
            if coarse:
                families.join_all(np.full(len(b), whole["id"]), b.c["id"])
                families.join_all(np.full(len(e), whole["id"]), e.c["id"])
            else:
                i, j = np.nonzero(one[:, None] != two[None, :])
                if b is e:
                    i, j = i[i < j], j[i < j]
                x, y = b.take(i).c, e.take(j).c
                ok = np.flatnonzero(may_link(x, y, rule))
                families.meet({k: v[ok] for k, v in x.items()}, {k: v[ok] for k, v in y.items()})
            two = families.labels(e.c["id"])
        self.before.append((e, whole))


def combine(e: Entries, rule: Rule, families: Families) -> Entries:
    """Entries sorted by list, of which those of a list of ``rule.combine`` or more are compared here and sent on as one for
    each family."""
    t = e.c["t"]
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, dtype=np.int64)
    length = np.diff(np.append(edge, len(t)))
    out = [e.take(np.flatnonzero(np.repeat(length < rule.combine, length)))]
    for at, m in zip(edge[length >= rule.combine].tolist(), length[length >= rule.combine].tolist(), strict=True):
        own = e.take(slice(at, at + m))
        own = own.take(np.argsort(own.c["lo"], kind="stable"))
        pairs = families.met
        lists = LongList(rule, families)
        for i in range(0, m, rule.list_block):
            lists.add(own.take(slice(i, i + rule.list_block)))
        families.met = pairs  # whoever isn't joined here meets again where the list comes together
        out.append(own.block(np.unique(families.labels(own.c["id"]), return_inverse=True)[1]))
    return Entries.joined(out)


_ENTRY = ", ".join(f"{k} long" for k in (*Entries.NAMES, "other"))
_MET = ["u", "v", "nu", "nv", "pu", "pv"]


def _family_edges(classes: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between sets that may be linked, of which every linked pair is connected."""

    def post(batches):
        held, size = [], 0

        def flush():
            families, e = Families(), Entries.joined(held)
            e = combine(e.take(np.argsort(e.c["t"], kind="stable")), rule, families)
            for i in range(0, len(e), 50_000):
                part = e.take(slice(i, i + 50_000))
                yield pa.RecordBatch.from_arrays([*(pa.array(part.c[k]) for k in Entries.NAMES), pa.nulls(len(part), pa.int64())], [*Entries.NAMES, "other"])
            if families.edges:  # they travel as entries whose ``other`` is set
                u, v = np.array(families.edges, dtype=np.int64).T
                zero = pa.array(np.zeros(len(u), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(mix(u.view(np.uint64)).view(np.int64)), *[zero] * 5, pa.array(u), *[zero] * SIGNATURE, pa.array(v)], [*Entries.NAMES, "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("prefix")
            size_of = np.diff(lists.offsets.to_numpy())
            t = lists.flatten().to_numpy()
            p = np.arange(len(t)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
            n, ids, *sign = (np.repeat(batch.column(k).to_numpy(), size_of) for k in ("n", "id", *_SIGN))
            held.append(Entries({"t": t, "lo": n, "hi": n, "far": p, "rest": n - p, "sets": np.ones(len(t), dtype=np.int64), "id": ids} | dict(zip(_SIGN, sign, strict=True))))
            size += len(t)
            if size > HELD_ENTRIES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        families = Families()
        held, token, lists = None, None, None

        def emit(last: bool):
            if families.edges and (last or len(families.edges) > 100_000):
                u, v = np.array(families.edges, dtype=np.int64).T
                families.edges = []
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[pa.nulls(len(u), pa.int64())] * 4], _MET)
            if families.met and (last or len(families.met) > 64 or sum(len(x[0]) for x in families.met) > 100_000):
                u, v, nu, nv, pu, pv = (np.concatenate(x) for x in zip(*families.met, strict=True))
                families.met = []
                turn = u > v
                swap = lambda x, y: (np.where(turn, y, x), np.where(turn, x, y))
                yield pa.RecordBatch.from_arrays([pa.array(x) for pair in ((u, v), (nu, nv), (pu, pv)) for x in swap(*pair)], _MET)

        for batch in batches:
            other = batch.column("other")
            if other.null_count < len(other):
                passed = np.flatnonzero(~other.is_null().to_numpy(zero_copy_only=False))
                families.join_all(batch.column("id").to_numpy()[passed], other.drop_null().to_numpy())
                batch = batch.filter(other.is_null())
            e = Entries({k: batch.column(k).to_numpy() for k in Entries.NAMES})
            if held is not None:
                e = Entries.joined([held, e])
                held = None
            if not len(e):
                continue
            t = e.c["t"]
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            length = np.diff(np.append(edge, len(t)))
            if t[0] != token:
                token, lists = None, None
            whole = np.append(np.ones(len(edge) - 1, dtype=bool), False)  # the last list may go on in the next batch
            if lists is not None:
                whole[0] = False
            short = (length <= rule.short_list) & whole
            short_lists(e.take(np.flatnonzero(np.repeat(short & (length > 1), length))), rule, families)
            for at, m in zip(edge[:-1][~short[:-1]].tolist(), length[:-1][~short[:-1]].tolist(), strict=True):
                if lists is None or t[at] != token:
                    lists = LongList(rule, families)
                for i in range(at, at + m, rule.list_block):
                    lists.add(e.take(slice(i, min(i + rule.list_block, at + m))))
                token, lists = None, None
            held = e.take(slice(edge[-1], None))
            if len(held) > rule.list_block:
                if lists is None:
                    lists = LongList(rule, families)
                token = t[-1]
                full = len(held) // rule.list_block * rule.list_block
                for i in range(0, full, rule.list_block):
                    lists.add(held.take(slice(i, i + rule.list_block)))
                held = held.take(slice(full, None))
            yield from emit(False)
        if held is not None and len(held):
            (lists or LongList(rule, families)).add(held)
        yield from emit(True)

    dealt = classes.select("id", "n", "prefix", *_SIGN).mapInArrow(trimmed(post), _ENTRY).repartition("t").sortWithinPartitions("t", "lo", "id")
    met = scratch.cut(dealt.mapInArrow(trimmed(meet), ", ".join(f"{k} long" for k in _MET)), "met")
    pairs = met.filter("nu is not null").groupBy("u", "v").agg(F.count(F.lit(1)).alias("s"), *(F.max(k).alias(k) for k in _MET[2:]))
    # Linked sets share so many shingles of their prefixes; what one has before their last common one and doesn't
    # share is lacking in the other.
    percent = F.lit(rule.percent)
    needed = F.ceil(percent * (F.col("nu") + F.col("nv")) / (100 + rule.percent))
    shared = needed - F.ceil(percent * F.greatest("nu", "nv") / 100) + 1
    may = (F.col("s") >= shared) & (F.col("pu") - F.col("s") + 1 <= F.col("nu") - needed) & (F.col("pv") - F.col("s") + 1 <= F.col("nv") - needed)
    return met.filter("nu is null").select("u", "v").unionByName(pairs.filter(may).select("u", "v"))


# ---------------------------------------------------------------- tiles


class Tile:
    """Sets whose intersections with all sets of the tile are asked for, one set after the other."""

    def __init__(self, sets: list[np.ndarray], keep_answers: int = ANSWERED):
        self.keep_answers = keep_answers
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        shingles = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(shingles, kind="stable")
        shingles, of_sorted = shingles[order], of[order]
        new = np.concatenate([[True], shingles[1:] != shingles[:-1]])
        at = np.flatnonzero(new)
        # Shingles of one set alone change no intersection.
        often = np.diff(np.append(at, len(shingles))) > 1
        column = np.cumsum(new) - 1
        keep = often[column]
        number = np.cumsum(often) - 1
        self.sets_of = of_sorted[keep]
        count = np.diff(np.append(at, len(shingles)))[often]
        self.first = np.concatenate([[0], np.cumsum(count)])
        own = np.full(len(of), -1, dtype=np.int64)
        own[order] = np.where(keep, number[column], -1)
        cut = np.concatenate([[0], np.cumsum(self.size)])
        self.columns = [c[c >= 0] for c in (own[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True))]
        self.answered: list[tuple[np.ndarray, np.ndarray]] = []
        self.derived = 0

    def _counts(self, columns: np.ndarray) -> np.ndarray:
        first, size = self.first[columns], self.first[columns + 1] - self.first[columns]
        if not len(columns):
            return np.zeros(len(self.size), dtype=np.int64)
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.sets_of[at], minlength=len(self.size))

    def intersections(self, i: int) -> np.ndarray:
        """Sizes of set i's intersections with all sets, derived from the most similar answered set where one has half
        of its shingles."""
        own = self.columns[i]
        near = max(self.answered, key=lambda a: a[1][i], default=None)
        if near is not None and 2 * near[1][i] >= len(own) and len(own):
            self.derived += 1
            return near[1] + self._counts(np.setdiff1d(own, near[0], assume_unique=True)) - self._counts(np.setdiff1d(near[0], own, assume_unique=True))
        out = self._counts(own)
        self.answered = [*self.answered, (own, out)][-self.keep_answers :]
        return out


def tile_links(sets: list[np.ndarray], label: np.ndarray, asked: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links (i, j) that join the components, given by ``label``, of asked sets with those of any sets."""
    label, out = label.copy(), []
    if len(sets) < 2 or (label == label[0]).all():
        return out
    tile = Tile(sets, rule.answered)
    for i in asked.tolist():
        inter = tile.intersections(i)
        hit = np.flatnonzero((100 * inter >= rule.percent * (tile.size + tile.size[i] - inter)) & (label != label[i]))
        if not len(hit):
            continue
        met, first = np.unique(label[hit], return_index=True)
        out += [(i, int(j)) for j in hit[first]]
        label[np.isin(label, met)] = label[i]
        if (label == label[0]).all():
            break
    return out


def _solve(dealt: DataFrame, rule: Rule, keys: list[str]) -> DataFrame:
    """Links of the tiles, whose rows (keys, id, q, ask, s) follow each other."""

    def work(batches):
        at, rows = None, []

        def solve():
            number: dict[int, int] = {}
            ids, sets, labels, asked = [], [], [], []
            for i, q, ask, s in rows:
                if i not in number:
                    number[i] = len(ids)
                    ids.append(i)
                    sets.append(s)
                    labels.append(q)
                if ask:
                    asked.append(number[i])
            links = tile_links(sets, np.array(labels, dtype=np.int64), np.array(sorted(set(asked)), dtype=np.int64), rule)
            if links:
                u, v = np.array(ids, dtype=np.int64)[np.array(links).T]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            s = batch.column("s")
            for r, (name, i, q, ask) in enumerate(zip(names, batch.column("id").to_pylist(), batch.column("q").to_pylist(), batch.column("ask").to_pylist(), strict=True)):
                if name != at:
                    if rows:
                        yield from solve()
                    at, rows = name, []
                rows.append((i, q, ask, np.frombuffer(s[r].as_buffer(), dtype=np.uint64).copy()))
        if rows:
            yield from solve()

    dealt = dealt.select(*keys, "id", "q", "ask", "s").repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(trimmed(work), "u long, v long")


def _links(classes: DataFrame, rows: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The written table (u, root) of the components that all links have, of set numbers."""
    edges = _family_edges(classes, rule, scratch)
    family = components(edges, scratch, "families")
    scratch.drop("met")
    members = family.join(classes.select("id", "c", "d", "n"), F.col("u") == F.col("id")).select("id", "c", "d", "n", "root")
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("parts"), F.count(F.lit(1)).alias("sets"))
    parts = scratch.cut(parts, "parts")
    members = scratch.cut(join_groups(members, parts, ["root"], "sets", "id"), "members")
    needed = rows.sparkSession.sparkContext.broadcast(bloom_of(members.select(F.col("c").alias("h")), scratch, "wanted"))
    own = members.select("c", "d", "id", "root", "parts", "sets", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"))
    sets = scratch.cut(_class_sets(rows, rule, needed).join(own, ["c", "d"]).drop("c", "d"), "sets")
    scratch.sweep()

    pilot = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit(1), "id"), F.col("sets")) < PILOTS)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = sets.withColumn("i", F.explode(F.when(pilot, every).otherwise(F.array("i"))))
    links = scratch.cut(_solve(first.withColumns({"q": F.col("id"), "ask": F.lit(True)}), rule, ["root", "i"]), "tile_links")
    near = components(links, scratch, "near")

    # Families of several tiles: who isn't of the main component meets all tiles, in blocks.
    large = sets.filter("parts > 1")
    if large.isEmpty():
        return near
    large = large.join(near.select(F.col("u").alias("id"), F.col("root").alias("q")), "id", "left").withColumn("q", F.coalesce("q", "id"))
    large = scratch.cut(large, "large")
    kinds = large.groupBy("root", "q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("s") / 8).alias("shingles"))
    main = kinds.groupBy("root").agg(F.max(F.struct("n", "q"))["q"].alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("sets"), F.sum("shingles").alias("all"), F.max_by("shingles", F.struct("n", "q")).alias("held"))
    main = scratch.cut(main.filter("kinds > 1").select("root", "main", "sets", F.ceil((F.col("all") - F.col("held")) / TILE_SHINGLES).cast("int").alias("blocks")), "main")
    large = join_groups(large.drop("sets"), main, ["root"], "sets", "id").filter("main is not null")
    blocks_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    stay = large.withColumns({"b": F.explode(blocks_), "ask": F.lit(False)})
    go = large.filter("q <> main").withColumn("b", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("blocks")).cast("int"))
    go = go.withColumn("i", F.explode(every)).withColumn("ask", F.lit(True))
    columns = ["root", "i", "b", "id", "q", "ask", "s"]
    more = scratch.cut(_solve(stay.select(*columns).unionByName(go.select(*columns)), rule, ["root", "i", "b"]), "more_links")
    return components(links.unionByName(more), scratch, "all")


def _joined(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """k, h (hash of the text), n, component_id and ``first`` of each row: whether its set is the one that its
    component's smallest key stands for."""
    scratch, rule = Scratch(docs.sparkSession), Rule(words, percent)
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("h"))
    profiles = scratch.cut(_profiles(rows, rule, share(_hot_shingles(rows, rule, scratch))), "profiles")
    classes = profiles.filter("n > 0").groupBy("c", "d").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("rows"), F.first(F.struct("n", "prefix", *_SIGN)).alias("x")).select("c", "d", "least", "rows", "x.*")
    classes = scratch.cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    scratch.drop("hot")
    scratch.sweep()
    roots = _links(classes, rows, rule, scratch)
    scratch.drop("families", "parts", "members", "sets", "tile_links", "large", "main", "more_links")

    of = classes.select("c", "d", "id", "rows", "least").join(roots.select(F.col("u").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = scratch.cut(of, "roots")
    best = F.struct(F.col("least").isNull(), "least", "c", "d")
    whole = scratch.cut(of.groupBy("root").agg(F.min("least").alias("component_id"), F.min(best).alias("best"), F.count(F.lit(1)).alias("sets")), "wholes")
    of = join_groups(of, whole, ["root"], "sets", "id").select("c", "d", "rows", "component_id", ((F.col("c") == F.col("best.c")) & (F.col("d") == F.col("best.d"))).alias("first"))
    of = scratch.cut(of, "components")
    scratch.drop("classes", "near", "all", "roots", "wholes")
    out = join_groups(profiles.select("k", "h", "n", "c", "d"), of, ["c", "d"], "rows", "h")
    return out.select("k", "h", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """One row for each input row: key, n_shingles, component_id.

    Null texts and texts without words have no shingle and are linked with nothing: component_id is their own key.
    component_id is else the smallest key that links reach; rows that repeat a key and a text are one node, null keys
    are passed over by the minimum.  A very long text is one set of any size.  An empty table gives an empty result;
    other columns are ignored.
    """
    return _joined(docs, text, key, words, percent).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """The rows of one document of each component, that with the smallest key, with all their columns.

    Rows go by key and text: of two near copies under one key one stays, and a text that only shares its key with a
    near copy stays.  Documents without a shingle, and rows without a key, stay; so do rows that repeat key and text of
    the one that stays.  An empty table gives an empty result.
    """
    gone = _joined(docs, text, key, words, percent).filter((F.col("k") != F.col("component_id")) | ~F.col("first"))
    gone = gone.select(F.col("k").alias("_gone"), F.col("h").alias("_text")).distinct()
    return docs.join(gone, (docs[key] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_text"]), "left_anti")
