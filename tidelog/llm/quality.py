"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows (``FIT_ROWS``), by histograms of ``BINS``
quantile bins, and flattened into arrays; one pass over the texts computes each document's statistics and walks
all trees of a batch at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, grams, text_buffer, word_hashes, word_spans, trimmed

#: The trees are fitted on so many labelled rows at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 80, 5, 0.15, 10, 1.0
#: A score from here on predicts label 1.
CUT = 0.3

_CLASS = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_b >= 128, "A" <= _c <= "Z", "a" <= _c <= "z", "0" <= _c <= "9", _c in ".,;:?'\"()-", 33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:?'\"()-"]
NAMES = ["bytes", "words", "word_bytes", "longest_word", "wide", "upper", "lower", "digit", "stop", "symbol", "byte_entropy", "lines", "line_words", "same_lines", "distinct_words", "top_word", "echo", "again_2", "again_4", "symbol_words", "upper_words", "punct_end", "worst_symbol_line", "commonest_symbol"]


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: hashes, distinct hashes, and the count of the commonest."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc)) if len(h) else np.empty(0, dtype=np.int64)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, doc[at], run)
    return total, np.bincount(doc[at], minlength=n), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text, in the order of NAMES; an empty text gives zeros."""
    n, size = len(off) - 1, np.diff(off)
    of = np.repeat(np.arange(n), size)
    hist = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256)
    per = np.maximum(size, 1)[:, None]
    share = hist @ _CLASS / per
    p = hist / per
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    symbols = hist * _CLASS[:, 5]
    start, end, doc = word_spans(data, off)
    words, _ = word_hashes(data, off)
    total, distinct, most = _repeats(words, doc, n)
    some = np.maximum(total, 1)
    length = end - start
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    same = np.zeros(n)
    if len(words) > 1:
        same = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    two, four = (_repeats(*grams(words, doc, k), n) for k in (2, 4))
    kind = _CLASS[data] if len(data) else np.empty((0, 6))
    sym = np.concatenate([[0], np.cumsum(kind[:, 5])])
    up = np.concatenate([[0], np.cumsum(kind[:, 1])])
    low = np.concatenate([[0], np.cumsum(kind[:, 2])])
    word_sym = sym[end] > sym[start]
    word_up = (up[end] - up[start] > 1) & (low[end] == low[start])
    last = data[end - 1] if len(end) else np.empty(0, dtype=np.uint8)
    # Lines: of the words between line ends.
    feeds = np.flatnonzero(data == 10)
    line = np.searchsorted(feeds, start) + doc  # texts end lines as well
    first = np.ones(len(line), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    lines = np.bincount(doc[at], minlength=n)
    worst = np.zeros(n)
    if len(at):
        with np.errstate(over="ignore"):
            text = np.add.reduceat(words * (np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words)))) + 1).astype(np.uint64), at)
        _, kinds, _ = _repeats(text, doc[at], n)
        bad = np.add.reduceat(word_sym.astype(float), at) / np.diff(np.append(at, len(words)))
        np.maximum.at(worst, doc[at], bad)
    else:
        kinds = lines
    count = lambda flag: np.bincount(doc, weights=flag, minlength=n) / some
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(total),
            np.bincount(doc, weights=length, minlength=n) / some,
            np.log1p(longest),
            share,
            entropy,
            np.log1p(lines),
            total / np.maximum(lines, 1),
            1 - kinds / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
            distinct / some,
            most / some,
            same / some,
            1 - two[1] / np.maximum(two[0], 1) - (two[0] == 0),
            1 - four[1] / np.maximum(four[0], 1) - (four[0] == 0),
            count(word_sym),
            count(word_up),
            count(np.isin(last, np.frombuffer(b".!?", dtype=np.uint8))),
            worst,
            symbols.max(1) / some,
        ]
    ).astype(np.float32)


def _rows(docs: DataFrame, text: str, keep: list[str], work, schema: str) -> DataFrame:
    """``work`` gives the columns after ``keep`` from the statistics of each row; null texts count as empty."""
    names = [f"x{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("t"))
            parts = [statistics(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
            if parts:
                yield from work(batch, np.concatenate(parts))

    kept = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(trimmed(run), kept + schema)
    return out.toDF(*keep, *out.columns[len(keep) :])


class Trees:
    """Boosted trees as arrays: node i tests column[i] <= bound[i] and goes to child[2 i] or child[2 i + 1]; leaves go to themselves."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.column, self.bound, self.child, self.value = [], [], [], []

    def node(self) -> int:
        i = len(self.column)
        self.column.append(0)
        self.bound.append(np.inf)
        self.child += [i, i]
        self.value.append(0.0)
        return i

    def freeze(self) -> Trees:
        self.roots, self.column = np.array(self.roots, dtype=np.int64), np.array(self.column, dtype=np.int64)
        self.bound, self.child, self.value = np.array(self.bound), np.array(self.child, dtype=np.int64), np.array(self.value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; every tree of every row takes a step at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = self.child[2 * at + (x[rows, self.column[at]] > self.bound[at])]
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Log-loss boosting; without both labels the score is the rate of label 1, or one half without labels."""
    rate = float(y.mean()) if len(y) else 0.5
    out = Trees(float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    if len(y) == 0 or rate in (0.0, 1.0):
        return out.freeze()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    flat = bins + np.arange(x.shape[1]) * BINS
    score = np.full(len(y), out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        root = out.node()
        out.roots.append(root)
        open_nodes = [(root, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            following = []
            for node, rows in open_nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                split = None
                if depth < DEPTH and len(rows) >= 2 * LEAST:
                    cells, size = flat[rows].ravel(), BINS * x.shape[1]
                    cum = lambda w: np.bincount(cells, None if w is None else np.repeat(w[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(1)  # noqa: B023, E731
                    lg, lh, ln = cum(grad), cum(hess), cum(None)
                    gain = lg**2 / (lh + RIDGE) + (g - lg) ** 2 / (h - lh + RIDGE) - g**2 / (h + RIDGE)
                    gain[(ln < LEAST) | (len(rows) - ln < LEAST)] = 0
                    col, cell = divmod(int(gain.argmax()), BINS)
                    if gain[col, cell] > 1e-3 and cell < len(edges[col]):
                        split = col, cell
                if split is None:
                    out.value[node] = -RATE * g / (h + RIDGE)
                    score[rows] += out.value[node]
                    continue
                col, cell = split
                left, right = out.node(), out.node()
                out.column[node], out.bound[node] = col, float(edges[col][cell])
                out.child[2 * node], out.child[2 * node + 1] = left, right
                side = bins[rows, col] <= cell
                following += [(left, rows[side]), (right, rows[~side])]
            open_nodes = following
    return out.freeze()


def _held(key: str):
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from at most ``fit_rows`` labelled rows with crc32(key) mod 5 not 0, those with the least hashes of the key.

    Of several labels of a key the mean counts; null labels and keys don't.  A key that several rows have is learned
    with one of their texts, that with the least hash, so the sample has ``fit_rows`` rows at most.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_k").isNotNull() & ~_held("_k"))
    known = known.groupBy("_k").agg((F.avg("_y") >= 0.5).cast("double").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(fit_rows)
    # fit_rows bounds the broadcast side.
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).join(F.broadcast(known), "_k")
    rows = rows.groupBy("_k", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), "_t")).alias("_one")).select("_k", "_y", F.col("_one._t").alias("_t"))

    def give(batch, x):
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("x0"), flat], ["x0", "f"])

    sample = _rows(rows, "_t", ["_y"], give, "f array<float>").toArrow()
    x = sample["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sample), len(NAMES))
    return fit(x, sample["_y"].to_numpy().astype(float))


def score_rows(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``_score`` of each row, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most TREES * 2 ** (DEPTH + 1) nodes

    def give(batch, x):
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(x))], [*batch.schema.names[:-1], "_score"])

    return _rows(docs, text, keep, give, "_score double")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """key, held_out, score, predicted of each row.

    Null and empty texts are scored from their zeros, very long ones whole; without labels every score is 0.5.  Repeated rows are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    out = score_rows(docs, learn(docs, labels, text, key, label, fit_rows), [key], text)
    return out.select(key, _held(key).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows that are predicted 1, with all their columns.

    Null and empty texts are scored from their zeros; repeated rows go or stay together; without labels, and in an
    empty table, every row stays.  Texts of any length are read whole.
    """
    trees = learn(docs, labels, text, key, label)
    return score_rows(docs, trees, docs.columns, text).filter(F.col("_score") >= CUT).drop("_score")
