"""Exact top-k by inner product as a Voronoi kNN join.

One more coordinate, sqrt(M - |x|^2) with M the largest squared length, turns the inner product into Euclidean
distance: |(q, 0) - (x, r)|^2 = |q|^2 + M - 2 q.x.  Data go to the cell of their nearest pivot, and so do queries.
Each cell's summary is its radius and the distances of its k nearest members to the pivot.  From the summaries alone
every cell of queries gets a bound on the distance of its k-th answer, and a vector is sent only where the triangle
inequality lets it be nearer than that.

Cells of queries are packed into groups of ``GROUP_BYTES``; a larger cell is split.  A vector is sent to a group once,
if any of the group's cells can use it, so it is copied for each group and not for each cell.  In a task a group's
queries come first and blocks of data stream past them; the tasks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, trimmed

#: Most pivots; about the square root of the rows is taken.
PIVOTS = 256
#: Bytes of a group of queries and of a block of data in a task's memory; data rows that meet one copy of a group, and
#: queries whose scores of a block are held at a time.
GROUP_BYTES, BLOCK_BYTES, PART_ROWS, SCORED = 16 << 20, 4 << 20, 1 << 18, 256
SCALE = 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(k, x): vectors of floor(scale * component); rows with a null key, a null or a non-finite component are left out."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(key).cast("long").alias("k"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the list column; shorter vectors end in zeros, which add nothing to a product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point as long as no sum can leave 53 bits."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Cells:
    """Pivots, and the distances of vectors from them with the extra coordinate."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.pivots, self.largest = pivots, largest

    def extended(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((points * points).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * points @ p.T, 0))


def _nearest(q: pa.RecordBatch | None, cells: Cells, width: int, query: bool):
    x = _matrix(q.column("x"), width)
    d = cells.distances(np.column_stack([x, np.zeros(len(x))]) if query else cells.extended(x))
    return x, d, d.argmin(1)


def pack(cells: dict[int, int], place: np.ndarray, most: int) -> dict[int, list[int]]:
    """The groups of each cell, given its number of queries: cells near each other share a group of ``most`` queries, and
    a larger cell has several groups of its own."""
    out, group, size = {}, 0, 0
    for c in sorted(cells, key=lambda c: (place[c], c)):
        if size and size + cells[c] > most:
            group, size = group + 1, 0
        need = max(1, -(-cells[c] // most))
        out[c] = list(range(group, group + need))
        if need > 1:
            group, size = group + need, 0
        else:
            size += cells[c]
    return out


def search(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best by integer inner product, ties to the smaller id.

    ``is_query`` is a condition on the key, named ``k``.  A query is no answer of its own.  Fewer than k other vectors
    give fewer answers.  Vectors of different lengths are compared as if the shorter ended in zeros.  Rows that repeat a
    key are each candidates of other queries, and of no query of that key; the query is asked once.  Empty tables
    give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    data = scratch.cut(quantised(vectors, key, vector, scale), "data")
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    facts = data.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(square)).first()
    rows, width, largest = facts[0], facts[1] or 0, float(facts[2] or 0)
    # Pivots: the vectors with the least hashes of their ids, spread over the data like any fixed random choice.
    some = max(1, min(pivots, round(rows**0.5)))
    chosen = data.orderBy(F.xxhash64("k"), "k").limit(some).select("x").collect()  # at most ``pivots`` vectors
    first = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        first[i, : len(row["x"])] = row["x"]
    cells = Cells(np.empty((0, width + 1)), largest)
    cells.pivots = cells.extended(first) if len(first) else np.zeros((1, width + 1))
    share = spark.sparkContext.broadcast(cells)
    slack = 1e-6 * (1 + np.sqrt(largest))

    def summarise(batches):
        for batch in batches:
            x, d, cell = _nearest(batch, share.value, width, False)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["k", "cell", "d"])

    def groups(batches):
        for batch in batches:
            x, d, cell = _nearest(batch, share.value, width, True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["cell", "d"])

    queries = data.filter(is_query).dropDuplicates(["k"])
    near = data.mapInArrow(trimmed(summarise), "k long, cell int, d double")
    order = Window.partitionBy("cell").orderBy("d")
    nearest = near.dropDuplicates(["k"]).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("near"))
    summary = near.groupBy("cell").agg(F.max("d").alias("radius")).join(nearest, "cell", "left").withColumn("near", F.coalesce("near", F.array().cast("array<double>"))).collect()  # a row for each pivot
    asked = queries.mapInArrow(trimmed(groups), "cell int, d double").groupBy("cell").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pivot
    reach = {row["cell"]: float(row["far"]) for row in asked}

    # Upper bound of the k-th distance of each group: through its own pivot to the nearest members of each cell, one for
    # each key.  One more than k, as the query may be among them.
    between = cells.distances(cells.pivots)
    n = len(cells.pivots)
    bound, radius = np.full(n, -np.inf), np.full(n, -np.inf)
    for row in summary:
        radius[row["cell"]] = row["radius"]
    for g, far in reach.items():
        through = np.sort(np.concatenate([far + between[g, row["cell"]] + np.array(row["near"]) for row in summary]))
        bound[g] = through[k] if len(through) > k else np.inf
    # A cell is of use to a group unless its nearest possible member is too far.
    useful = np.zeros((n, n), dtype=bool)
    for g in reach:
        useful[g] = (radius >= 0) & (between[g] - reach[g] - radius <= bound[g] + slack)
    held = pack({row["cell"]: row["n"] for row in asked}, between[0], max(1, GROUP_BYTES // (8 * max(width, 1))))
    plan = spark.sparkContext.broadcast((between, bound, reach, useful, held))
    count = sum(map(len, {tuple(g) for g in held.values()}))
    parts = max(1, -(-rows // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")) // max(count, 1))
    block_rows = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    def spread(ids):
        return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def replicate(batches):
        between, bound, reach, useful, held = plan.value
        for batch in batches:
            x, d, cell = _nearest(batch, share.value, width, False)
            own = d[np.arange(len(x)), cell]
            ids = batch.column("k").to_numpy()
            block = spread(ids) % parts
            wanted: dict[int, np.ndarray] = {}
            for c, groups_ in held.items():
                # A vector is at least as far from a query as from the cell's pivot, less the cell's reach.
                low = np.maximum(d[:, c], np.abs(between[c][cell] - own)) - reach[c]
                keep = useful[c][cell] & (low <= bound[c] + slack)
                for g in groups_:
                    wanted[g] = wanted.get(g, False) | keep
            for g, keep in wanted.items():
                at = np.flatnonzero(keep)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, dtype=np.int32)), pa.array(block[at].astype(np.int32)), pa.array(ids[at]), batch.column("x").take(pa.array(at)), pa.array(np.ones(len(at), dtype=bool))], ["g", "b", "k", "x", "data"])

    def ask(batches):
        held = plan.value[4]
        for batch in batches:
            _, _, cell = _nearest(batch, share.value, width, True)
            turn = spread(batch.column("k").to_numpy())
            g = np.array([held[c][t % len(held[c])] for c, t in zip(cell.tolist(), turn.tolist(), strict=True)], dtype=np.int32)
            for b in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(batch.num_rows, b, dtype=np.int32)), batch.column("k"), batch.column("x"), pa.array(np.zeros(batch.num_rows, dtype=bool))], ["g", "b", "k", "x", "data"])

    def solve(batches):
        at, asked, stored = None, [], []

        def best():
            if not asked or not stored:
                return
            xi, x = np.concatenate([s[0] for s in stored]), np.concatenate([s[1] for s in stored])
            qi, q = np.concatenate([s[0] for s in asked]), np.concatenate([s[1] for s in asked])
            order = np.argsort(xi, kind="stable")
            xi, x = xi[order], x[order]
            for i in range(0, len(qi), SCORED):
                ids = qi[i : i + SCORED]
                score = products(q[i : i + SCORED], x)
                score[ids[:, None] == xi[None, :]] = np.iinfo(np.int64).min
                m = min(k, score.shape[1])
                # Equal scores at the edge go to smaller ids: all at or above the m-th score, in order.
                edge = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
                r, c = np.nonzero(score >= edge[:, None])
                got = score[r, c]
                o = np.lexsort((xi[c], -got, r))
                r, c, got = r[o], c[o], got[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                ok = (rank < k) & (got != np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r[ok]]), pa.array(xi[c[ok]]), pa.array(got[ok])], ["query_id", "vec_id", "score"])

        for batch in batches:
            key_of = batch.column("g").to_numpy().astype(np.int64) << 32 | batch.column("b").to_numpy()
            ids, flag, x = batch.column("k").to_numpy(), batch.column("data").to_numpy(zero_copy_only=False), _matrix(batch.column("x"), width)
            edge = np.append(np.flatnonzero(np.concatenate([[True], key_of[1:] != key_of[:-1]])), len(key_of))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if key_of[i] != at:
                    yield from best()
                    at, asked, stored = key_of[i], [], []
                f = flag[i:j]
                if (~f).any():
                    asked.append((ids[i:j][~f].copy(), x[i:j][~f].copy()))
                if f.any():
                    stored.append((ids[i:j][f].copy(), x[i:j][f].copy()))
                if sum(len(s[0]) for s in stored) >= block_rows:  # queries come first
                    yield from best()
                    stored = []
        yield from best()

    schema = "g int, b int, k long, x array<double>, data boolean"
    dealt = data.mapInArrow(trimmed(replicate), schema).unionByName(queries.mapInArrow(trimmed(ask), schema)).repartition("g", "b").sortWithinPartitions("g", "b", "data")
    found = dealt.mapInArrow(trimmed(solve), "query_id long, vec_id long, score long")
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
