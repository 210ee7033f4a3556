"""Language identification by multilingual mixture inference.

A document is taken as a mixture of languages, each with its own distribution of lower-cased byte
trigrams.  Expectation-maximisation estimates the proportions, first of all languages; they are then left out
one by one, the least first, and the set with the best penalised likelihood gives the answer.  All documents of a
batch are solved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import LOWER, blocks, crc_mod, text_buffer, trimmed

#: Trigrams are hashed to so many features; the model has as many numbers for each language.
FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
SMOOTH = 0.5
STEPS = 8
#: Weight of the penalty, half the free proportions times the log of the trigrams.
PENALTY = 2.0

# ASCII letters and all bytes of other letters count; the rest is one separator.
_KEEP = np.full(256, 0x20, dtype=np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
assert LOWER[65] == 97


def trigram_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram within a text, other than of separators alone, and the text's number."""
    if len(data) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    c = _KEEP[data]
    code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (doc[:-2] == doc[2:]) & (c[1:-1] != 0x20)
    code = code[ok]
    f = ((code * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
    return f, doc[:-2][ok]


def _each(batches, columns):
    for batch in batches:
        data, off = text_buffer(batch.column("t"))
        for i, j in blocks(off):
            yield batch, i, j, trigram_features(data[off[i] : off[j]], off[i : j + 1] - off[i])


def learn(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """The languages, and the log-probability of each feature in each: counts over all rows with a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, i, j, (f, doc) in _each(batches, "lt"):
            langs = batch.column("l").slice(i, j - i).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            table = np.bincount(code[doc] * FEATURES + f, minlength=len(names) * FEATURES).reshape(-1, FEATURES)
            for name, row in zip(names, table, strict=True):
                sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["l", "f", "n"])
            if not len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int32()), pa.array([0], pa.int64())], ["l", "f", "n"])

    # One row for each language and feature.
    got = rows.mapInArrow(trimmed(count), "l string, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(got["l"].unique().tolist())
    table = np.full((len(names), FEATURES), SMOOTH)
    np.add.at(table, (np.searchsorted(names, got["l"].to_numpy(dtype=str)) if names else [], got["f"].to_numpy(dtype=int)), got["n"].to_numpy(dtype=float))
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixtures(f: np.ndarray, doc: np.ndarray, n: int, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: the number of its main language (-1 without trigrams) and that language's proportion."""
    pred, share = np.full(n, -1), np.zeros(n)
    if not len(f) or not len(model):
        return pred, share
    # Distinct features of each text, with counts.
    parts = []
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        h = np.bincount(f[bounds[d] : bounds[d + 1]], minlength=FEATURES)
        at = np.flatnonzero(h)
        parts.append((at, h[at]))
    have = np.array([len(p[0]) for p in parts])
    live = np.flatnonzero(have)
    feat = np.concatenate([parts[d][0] for d in live])
    count = np.concatenate([parts[d][1] for d in live]).astype(np.float32)
    start = np.concatenate([[0], np.cumsum(have[live])[:-1]])
    of = np.repeat(np.arange(len(live)), have[live])
    logp = model[:, feat].T  # entries x languages
    alone = np.add.reduceat(logp * count[:, None], start, axis=0)
    k = len(model)
    pick = np.argsort(-alone, axis=1, kind="stable")[:, :k]
    logp = np.take_along_axis(logp, pick[of], axis=1)
    top = logp.max(1, keepdims=True)
    p = np.exp(logp - top)
    base = np.add.reduceat(top[:, 0] * count, start)
    total = np.add.reduceat(count, start)
    active = np.ones((len(live), k), dtype=bool)
    weight = np.full((len(live), k), 1 / k, dtype=np.float32)
    best, best_weight = np.full(len(live), -np.inf), weight
    for size in range(k, 0, -1):
        for _ in range(STEPS if size > 1 else 1):
            r = p * weight[of]
            mass = r.sum(1)
            weight = np.add.reduceat(r * (count / mass)[:, None], start, axis=0) / total[:, None]
        fit = base + np.add.reduceat(np.log((p * weight[of]).sum(1)) * count, start)
        value = fit - PENALTY * (size - 1) / 2 * np.log(total + 1)
        better = value > best
        best, best_weight = np.where(better, value, best), np.where(better[:, None], weight, best_weight)
        if size > 1:
            least = np.where(active, weight, np.inf).argmin(1)
            active[np.arange(len(live)), least] = False
            weight = np.where(active, np.maximum(weight, 1e-6), 0).astype(np.float32)
            weight /= weight.sum(1, keepdims=True)
    main = best_weight.argmax(1)
    pred[live] = pick[np.arange(len(live)), main]
    share[live] = best_weight[np.arange(len(live)), main]
    return pred, np.clip(share, 0, 1)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score of each row.

    Learns from rows with crc32(key) mod 3 not 1, a language and a text.  A null text or one without a letter gives
    ``und`` and 0, as do all texts where nothing was learned; a text with a letter but no trigram gets the first
    language and the share it would have by chance.  Repeated rows are answered alike; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    names, table = learn(docs.filter(crc_mod(3) != 1) if key == "doc_id" else docs.withColumn("doc_id", F.col(key)).filter(crc_mod(3) != 1), text, lang)
    model = spark.sparkContext.broadcast((names, table))  # FEATURES numbers for each language
    held = F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 3 == 1
    rows = docs.select(F.col(key).alias("k"), held.alias("held_out"), F.col(text).cast("string").alias("t"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def work(batches):
        names, table = model.value
        for batch, i, j, (f, doc) in _each(batches, ""):
            pred, share = mixtures(f, doc, j - i, table)
            part = batch.slice(i, j - i)
            letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            bare = letter & (pred < 0)
            pred, share = np.where(bare, 0, pred), np.where(bare, 1 / max(1, len(names)), share)
            said = [names[p] if ok else "und" for p, ok in zip(pred, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(letter, share, 0.0).astype(float))], ["k", "held_out", "lang_pred", "score"])

    out = rows.mapInArrow(trimmed(work), f"k {rows.schema['k'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("k", key)
