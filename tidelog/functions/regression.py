"""Least-squares fits of key to position, and greedy piecewise linear regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an index entry; predictions may miss by two of them, those with two variables by eight.
ENTRY_BYTES = 40


def fit(log: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, slope, intercept): one line for each group, by aggregates; a constant x gives the mean of y."""
    out = log.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.avg(y).alias("_mean"))
    return out.select(group, "n", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "_mean").alias("intercept"))


def predict(slope: Column, intercept: Column, x: Column) -> Column:
    return F.round(slope * x + intercept)


def fit_plane(log: DataFrame, group: str, high: str, low: str, y: str, ridge: float = 1e-6) -> DataFrame:
    """(group, n, a, b, high0, low0): y = a (high - high0) + b (low - low0) through the mean of high and low, from sums.

    y isn't centred, as in the positions it stands for; a singular system gets ``ridge`` on its diagonal.
    """
    h, l, v = (F.col(c).cast("double") for c in (high, low, y))
    s = log.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(e).alias(n) for n, e in {"sh": h, "sl": l, "sy": v, "hh": h * h, "ll": l * l, "hl": h * l, "hy": h * v, "ly": l * v}.items()),
    )
    n = F.col("n")
    s = s.withColumns({"hh": F.col("hh") - F.col("sh") ** 2 / n, "ll": F.col("ll") - F.col("sl") ** 2 / n, "hl": F.col("hl") - F.col("sh") * F.col("sl") / n, "hy": F.col("hy") - F.col("sh") * F.col("sy") / n, "ly": F.col("ly") - F.col("sl") * F.col("sy") / n})
    flat = F.col("hh") * F.col("ll") - F.col("hl") ** 2 == 0
    s = s.withColumns({"hh": F.when(flat, F.col("hh") + ridge).otherwise(F.col("hh")), "ll": F.when(flat, F.col("ll") + ridge).otherwise(F.col("ll"))})
    det = F.col("hh") * F.col("ll") - F.col("hl") ** 2
    a = F.when(det != 0, (F.col("ll") * F.col("hy") - F.col("hl") * F.col("ly")) / det).otherwise(F.when(F.col("hy") != 0, F.col("hy") / F.col("hh")).otherwise(0.0))
    b = F.when(det != 0, (F.col("hh") * F.col("ly") - F.col("hl") * F.col("hy")) / det).otherwise(0.0)
    return s.select(group, "n", a.alias("a"), b.alias("b"), F.floor(F.col("sh") / n).alias("high0"), F.floor(F.col("sl") / n).alias("low0"))


class Line:
    """A growing least-squares line whose sums are compensated."""

    def __init__(self):
        self.x, self.y = [], []
        self.slope = self.intercept = 0.0
        self.sums = np.zeros(4)
        self.lost = np.zeros(4)

    def add(self, x: float, y: float, tolerance: float) -> bool:
        """Whether all points lie within the tolerance, cut to whole numbers, of the new line; else the line stays as it was."""
        old = self.slope, self.intercept
        self.x.append(x)
        self.y.append(y)
        term = np.array([x, y, x * x, x * y]) - self.lost
        total = self.sums + term
        self.lost = (total - self.sums) - term
        self.sums = total
        n, (sx, sy, sxx, sxy) = len(self.x), self.sums
        if n == 1:
            self.slope, self.intercept = 0.0, y
        elif n == 2 and self.x[1] != self.x[0]:
            self.slope = (self.y[1] - self.y[0]) / (self.x[1] - self.x[0])
            self.intercept = self.y[0] - self.slope * self.x[0]
        else:
            spread = sxx * n - sx * sx
            self.slope = (sxy * n - sx * sy) / spread if spread else 0.0
            self.intercept = (sy - self.slope * sx) / n
        error = np.abs(np.array(self.y) - self.slope * np.array(self.x) - self.intercept)
        if np.floor(error.max()) >= tolerance:
            self.slope, self.intercept = old
            return False
        return True


def greedy_segments(x, y, tolerance: float = 2 * ENTRY_BYTES) -> list[tuple[float, float, float, float, int]]:
    """(first x, last x, slope, intercept, points) of lines that are begun anew where a point doesn't fit."""
    out, line, first, last = [], Line(), None, None
    for a, b in zip(x, y, strict=True):
        if not line.add(float(a), float(b), tolerance):
            out.append((first, last, line.slope, line.intercept, len(line.x) - 1))
            line, first = Line(), None
            line.add(float(a), float(b), tolerance)
        first = float(a) if first is None else first
        last = float(a)
    if line.x:
        out.append((first, last, line.slope, line.intercept, len(line.x)))
    return out


#: Rows that a worker fits at a time, and cells of the tables in which groups advance together.
_ROWS, _CELLS = 1 << 17, 1 << 20


def greedy_groups(starts, x, y, tolerance: float = 2 * ENTRY_BYTES) -> tuple[np.ndarray, ...]:
    """(group, first x, last x, slope, intercept, points): ``greedy_segments`` of groups that lie end to end, in order.

    ``starts`` are the places of the groups' first points.  Groups advance together, a point of each at a time, by the
    operations of ``Line.add`` in their order, so the numbers are the same to the last bit.
    """
    x, y, starts = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64), np.asarray(starts, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(x)))
    order = np.argsort(-sizes, kind="stable")
    found, done = [], 0
    while done < len(order):
        some = order[done : done + max(1, _CELLS // int(sizes[order[done]]))]
        found += _advance(some, starts[some], sizes[some], x, y, tolerance)
        done += len(some)
    if not found:
        return np.zeros(0, dtype=np.int64), *(np.zeros(0) for _ in range(4)), np.zeros(0, dtype=np.int64)
    group, begin, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
    at = np.lexsort((begin, group))
    return group[at], *(c[at] for c in rest)


def _advance(group, starts, sizes, x, y, tolerance) -> list[tuple]:
    """Lines, with the places where they begin, of groups in falling order of size: a column each."""
    cell = np.minimum(starts + np.arange(sizes[0])[:, None], len(x) - 1)
    x, y, found, every = x[cell], y[cell], [], np.arange(len(group))
    sums, lost = np.zeros((4, len(group))), np.zeros((4, len(group)))
    begin, slope, intercept = np.zeros(len(group), dtype=np.int64), np.zeros(len(group)), np.zeros(len(group))

    def close(which, end):
        b = begin[which]
        found.append((group[which], b, x[b, which], x[end - 1, which], slope[which], intercept[which], end - b))

    for i in range(int(sizes[0])):
        k = int(np.searchsorted(-sizes, -i, side="left"))  # those with more than i points
        a, c, b = x[i, :k], y[i, :k], begin[:k]
        point = np.stack((a, c, a * a, a * c))
        term = point - lost[:, :k]
        total = sums[:, :k] + term
        rest = (total - sums[:, :k]) - term
        n, (sx, sy, sxx, sxy) = i - b + 1, total
        x0, y0 = x[b, every[:k]], y[b, every[:k]]
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = sxx * n - sx * sx
            m = np.where(spread != 0, (sxy * n - sx * sy) / spread, 0.0)
            d = (sy - m * sx) / n
            pair = (n == 2) & (a != x0)
            m = np.where(pair, (c - y0) / (a - x0), m)
        m = np.where(n == 1, 0.0, m)
        d = np.where(n == 1, c, np.where(pair, y0 - m * x0, d))
        low = int(b.min())
        error = np.abs(y[low : i + 1, :k] - m * x[low : i + 1, :k] - d)
        error[np.arange(low, i + 1)[:, None] < b] = 0
        off = np.floor(error.max(axis=0)) >= tolerance
        sums[:, :k], lost[:, :k] = np.where(off, point, total), np.where(off, 0.0, rest)
        if off.any():
            close(np.flatnonzero(off), i)
        slope[:k], intercept[:k] = np.where(off, 0.0, m), np.where(off, c, d)
        begin[:k][off] = i
    close(every, sizes)
    return found


def _joined(batches, cut, size):
    """Batches joined to tables of some ``size`` rows, of which all but the rows from place ``cut(table)`` on are given."""
    held, rows = [], 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= size:
            t = pa.concat_tables(held).combine_chunks()
            at = cut(t)
            if at:
                yield t.slice(0, at)
            held, rows = [t.slice(at)], 0  # the rest begins a group that may be long
    if held and (t := pa.concat_tables(held).combine_chunks()).num_rows:
        yield t


def _changes(column) -> np.ndarray:
    """Places, the first too, where a column differs from the row before."""
    code = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def piecewise(log: DataFrame, group: str, x: str, y: str, tolerance: float = 2 * ENTRY_BYTES) -> DataFrame:
    """(group, part, first, last, slope, intercept, points) of each group's greedy lines, in order of x.

    A group is one index block, so it is small by construction; rows stream through sorted partitions.  Rows without x or
    y are in no line.
    """
    kind, size = log.schema[group].dataType.simpleString(), _ROWS

    def work(batches):
        for t in _joined(batches, lambda t: int(_changes(t.column("g"))[-1]), size):
            starts = _changes(t.column("g"))
            of, *rest, points = greedy_groups(starts, t.column("x").to_numpy(), t.column("y").to_numpy(), tolerance)
            part = (np.arange(len(of)) - np.searchsorted(of, of)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks().take(pa.array(starts[of])), *map(pa.array, (part, *rest, points))], ["g", "part", "first", "last", "slope", "intercept", "points"])

    rows = log.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    out = rows.repartition("g").sortWithinPartitions("g", "x", "y").mapInArrow(work, f"g {kind}, part int, first double, last double, slope double, intercept double, points long")
    return out.withColumnRenamed("g", group)


def _rounded(v: np.ndarray) -> np.ndarray:
    """Whole numbers as by ``predict``: halves go away from zero."""
    whole = np.trunc(v)
    return whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0.0)


def in_window(group, x, pos, begin, end, lines) -> np.ndarray:
    """Whether each point (group, x, pos) stands in the window that ``search_window`` gives for its x.

    ``begin`` and ``end`` are the groups' bounds, and ``lines`` the (group, slope, intercept) of all lines, in order.
    """
    of, slope, intercept = lines
    first, number = np.searchsorted(of, np.arange(len(begin))), np.bincount(of, minlength=len(begin))
    low, high = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    for j in range(int(number.max(initial=0))):
        some = np.flatnonzero(number[group] > j)
        at = first[group[some]] + j
        guess = _rounded(slope[at] * x[some] + intercept[at])
        low[some], high[some] = np.minimum(low[some], guess), np.maximum(high[some], guess)
    off = 2 * ENTRY_BYTES
    begin, end = begin[group], end[group]
    low = np.maximum(np.maximum((low - off).astype(np.int64), begin), 0)
    low -= (low - begin) % ENTRY_BYTES
    high = np.maximum(np.minimum((high + off).astype(np.int64), end), low)
    high += ENTRY_BYTES - (high - begin) % ENTRY_BYTES
    return (pos >= low) & (pos < high + ENTRY_BYTES)


def lookups(entries: DataFrame, segment: str, key: str, block_rows: int) -> DataFrame:
    """(segment, n, held): whether the n-th entry of a segment by key stands in the window that the lines of its block of
    ``block_rows`` entries give for its key.

    Rows are dealt out and sorted once; places, lines and windows are made where the sorted rows stream by.  Places
    depend on keys alone, so entries of one key may come in any order.  An entry without a key is in no line, and its
    window is its block; one without a segment is in none.
    """
    kind, size = entries.schema[segment].dataType.simpleString(), _ROWS

    def work(batches):
        base = ahead = 0  # places in their segments of the first row of this table and of the next

        def blocks(t):
            first = _changes(t.column("g"))
            since = np.repeat(np.append(-base, first[1:]), np.diff(np.append(first, t.num_rows)))
            n = np.arange(t.num_rows) - since
            return n, np.flatnonzero((np.arange(t.num_rows) == since) | (n % block_rows == 0))

        def cut(t):
            nonlocal ahead
            n, starts = blocks(t)
            ahead = int(n[starts[-1]])
            return int(starts[-1])

        for t in _joined(batches, cut, size):
            n, starts = blocks(t)
            base = ahead
            rows = np.diff(np.append(starts, t.num_rows))
            group, pos, x = np.repeat(np.arange(len(starts)), rows), n * ENTRY_BYTES, t.column("x").to_numpy()
            held, some = np.ones(t.num_rows, dtype=bool), np.flatnonzero(~np.isnan(x))
            fitted = np.flatnonzero(np.append(True, np.diff(group[some]) > 0)) if len(some) else some
            of, _, _, slope, intercept, _ = greedy_groups(fitted, x[some], pos[some])
            lines = group[some][fitted][of], slope, intercept
            held[some] = in_window(group[some], x[some], pos[some], pos[starts], pos[starts + rows - 1], lines)
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks(), pa.array(n.astype(np.int32)), pa.array(held)], ["g", "n", "held"])

    rows = entries.select(F.col(segment).alias("g"), F.col(key).cast("double").alias("x")).filter("g is not null")
    out = rows.repartition("g").sortWithinPartitions("g", "x").mapInArrow(work, f"g {kind}, n int, held boolean")
    return out.withColumnRenamed("g", segment)


def search_window(models: DataFrame, keys: DataFrame, blocks: DataFrame, group: str, x: str) -> DataFrame:
    """(key, group, low, high): where each key can stand in its block, over all lines of the block, on entry bounds.

    ``blocks`` has (group, begin, end) of the blocks' positions; ``keys`` already names each key's block.
    """
    off = 2 * ENTRY_BYTES
    guess = predict(F.col("slope"), F.col("intercept"), F.col(x))
    w = keys.join(models, group).groupBy(group, x).agg((F.min(guess) - off).cast("long").alias("low"), (F.max(guess) + off).cast("long").alias("high")).join(blocks, group)
    low = F.greatest("low", "begin", F.lit(0))
    low = low - F.pmod(low - F.col("begin"), F.lit(ENTRY_BYTES))
    high = F.greatest(F.least("high", "end"), low)
    high = high + ENTRY_BYTES - F.pmod(high - F.col("begin"), F.lit(ENTRY_BYTES))
    return w.select(x, group, low.alias("low"), high.alias("high"))
