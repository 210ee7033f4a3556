"""Language-model scoring with a log-frequency Bloom filter.

The model interpolates word pairs with words, by the rate at which pairs of the corpus are new ones.  A gram seen c times is entered into the filter once for each
level 1 .. 1 + floor(log2(c)); a probe asks for level after level until one is missing, and so reads the
quantised count back.  All counts of the model, of words and of word pairs, are such probes.  The filter has
``ENTRY_BITS`` for each entry, however many there are.  Up to ``FILTER_BITS`` it is broadcast.  Beyond that it stays a
table of segments: texts are packed into chunks, a chunk's distinct grams go to the segments that they lie in, and
their levels come back, a byte for each.  Scores don't depend on the form.

The base score needs exact counts.  Words are hashed to 64 bits; the commonest ones, ``HEAD`` at most, are
broadcast with their counts, and all others are joined by shuffle.  No word outside the head is frequent,
so that join has no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, blocks, crc_mod, flat_broadcast, flat_view, mix, text_buffer, word_hashes, trimmed

#: Largest filter that is broadcast, 128 MiB, and the bits for each entry.
FILTER_BITS, ENTRY_BITS = 1 << 30, 9
#: The number of entries is foretold from word pairs whose hash is 0 modulo this.
SAMPLE = 256
#: Hashes that are counted at once.
HELD = 1_000_000
#: A segment of the filter is built by one task; a gram's bits lie in one block of it.
SEGMENT_BITS, BLOCK_BITS, PROBES = 1 << 20, 512, 4
#: Segments that are probed together where the filter isn't broadcast: 4 MiB.
GROUP = 32
#: Most words whose exact counts are broadcast: 16 MiB.
HEAD = 1 << 20
#: Hashes of the end of a text, and of what stands before its first word.
END, BEGIN = np.uint64(0xE4D0F7EE5A1DB00F), np.uint64(0xBE610F7EE5A1DB07)
_UNIGRAM, _BIGRAM = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
LEVELS = 48


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's hash, that of the token before it, and its text: a text's words and then its end."""
    n = len(off) - 1
    words, doc = word_hashes(data, off)
    count = np.bincount(doc, minlength=n)
    stop = np.cumsum(count + 1) - 1
    tokens = np.empty(len(words) + n, dtype=np.uint64)
    is_end = np.zeros(len(tokens), dtype=bool)
    is_end[stop] = True
    tokens[is_end], tokens[~is_end] = END, words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[stop[:-1] + 1] = BEGIN
    if len(tokens):
        before[0] = BEGIN
    return tokens, before, np.repeat(np.arange(n), count + 1)


def unigram(word: np.ndarray) -> np.ndarray:
    return mix(word ^ _UNIGRAM)


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before ^ _BIGRAM) + word)


def _place(gram: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of a gram, and the first bit of its block there."""
    low = gram & np.uint64(0xFFFFFFFF)
    block = (gram >> np.uint64(32)) % np.uint64(SEGMENT_BITS // BLOCK_BITS)
    return (low % np.uint64(segments)).astype(np.int64), block.astype(np.int64) * BLOCK_BITS


def _bits(gram: np.ndarray, level: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(gram + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return [((h >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES)]


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)); 0 for 0."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1)) + 1e-12), 0).astype(np.int64)


def probe(bits: np.ndarray, segments: int, gram: np.ndarray, first: int = 0) -> np.ndarray:
    """The level of each gram; ``bits`` begin with segment ``first``."""
    level = np.zeros(len(gram), dtype=np.int64)
    segment, block = _place(gram, segments)
    base, alive = (segment - first) * SEGMENT_BITS + block, np.arange(len(gram))
    for j in range(1, LEVELS):
        hit = np.ones(len(alive), dtype=bool)
        for bit in _bits(gram[alive], j):
            at = base[alive] + bit
            hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
        if not len(alive):
            break
        level[alive] = j
    return level


#: Mean count of a level: counts in [2 ** (j - 1), 2 ** j) are taken to fall off with the square.
_MEAN = np.array([0.0, *[2.0 ** (j - 1) * (1 if j == 1 else 1.386) for j in range(1, LEVELS)]])


def _counted(rows: DataFrame, what, columns: list[str], schema: str) -> DataFrame:
    """Counts of hashes, combined within a task for some blocks at a time.  ``what`` gives one or more arrays of hashes
    of a block; the array's number is the column b if that is asked for, and ``columns`` gives more columns by hash."""

    def work(batches):
        held, size = [], 0

        def flush():
            for b, arrays in enumerate(zip(*held, strict=True)):
                h, n = np.unique(np.concatenate(arrays), return_counts=True)
                for i in range(0, len(h), 50_000):
                    j = slice(i, i + 50_000)
                    cols = {"h": h[j].view(np.int64), "n": n[j], "b": np.full(len(h[j]), b, dtype=np.int8)}
                    cols |= {k: f(h[j]) for k, f in columns.items()}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[k]) for k in names], names)

        for batch in batches:
            data, off = text_buffer(batch.column("t"))
            for i, j in blocks(off):
                held.append(what(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                size += sum(map(len, held[-1]))
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.mapInArrow(trimmed(work), schema)


class Model:
    """Filter bits (or a broadcast of them; None where they are a table), segments, training tokens, different tokens,
    and the rate of different pairs."""

    def __init__(self, bits, segments: int, tokens: int, kinds: int, novelty: float):
        self.bits, self.segments, self.tokens, self.kinds, self.novelty = bits, segments, tokens, kinds, novelty

    def level(self, gram: np.ndarray) -> np.ndarray:
        return probe(self.bits, self.segments, gram)


class Answered(Model):
    """A model of which the levels of some sorted grams are at hand."""

    def __init__(self, model: Model, grams: np.ndarray, levels: np.ndarray):
        self.__dict__.update(model.__dict__)
        self.grams, self.levels = grams, levels

    def level(self, gram: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.grams, gram)]


class Head:
    """The commonest words, sorted by hash, and their exact counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts

    def known(self, word: np.ndarray) -> np.ndarray:
        """Exact count of a head word, else -1."""
        if not len(self.words):
            return np.full(len(word), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.counts[at], -1)


def probed(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The distinct grams, sorted, whose levels ``log_probability`` asks for."""
    return np.unique(np.concatenate([unigram(np.unique(np.concatenate([token, before]))), bigram(before, token)]))


class Trained:
    """What training gives: the model, the table ``made`` (s, bits) of the filter where it is too large to be broadcast,
    the table ``vocabulary`` (h, c) of all words' counts, the head and the count from which words are in it."""

    def __init__(self, model: Model, made: DataFrame | None, vocabulary: DataFrame, head: Head, least: int):
        self.model, self.made, self.vocabulary, self.head, self.least = model, made, vocabulary, head, least


def train(docs: DataFrame, scratch: Scratch, text: str = "text") -> Trained:
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("t"))

    def words(data, off):
        token, before, _ = sequences(data, off)
        pair = bigram(before, token)
        return token, pair[pair % np.uint64(SAMPLE) == 0]

    counted = scratch.cut(_counted(rows, words, {}, "h long, n long, b byte").groupBy("b", "h").agg(F.sum("n").alias("c")), "counted")
    vocabulary = counted.filter("b = 0").select("h", "c")
    # A row for each power of two: words or pairs, their tokens, and the entries that they need.
    level = F.floor(F.log2("c"))
    sizes = [(r["b"], r["level"], r["kinds"], r["tokens"]) for r in counted.groupBy("b", level.alias("level")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("tokens")).collect()]
    tokens, kinds = (sum(r[i] for r in sizes if r[0] == 0) for i in (3, 2))
    entries = sum(k * (lev + 1) * (SAMPLE if b else 1) for b, lev, k, _ in sizes)
    least, held = 1 << 62, 0
    for _, lev, k, _ in sorted((r for r in sizes if r[0] == 0), key=lambda r: -r[1]):
        held += k
        if held > HEAD:
            break
        least = 1 << int(lev)
    top = vocabulary.filter(F.col("c") >= least).toArrow()
    head = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(head)
    head = Head(head[order], top["c"].to_numpy().astype(np.int64)[order])
    del top, order

    segments = int(max(1, -(-ENTRY_BITS * entries // SEGMENT_BITS)))

    def pairs(data, off):
        token, before, _ = sequences(data, off)
        return (bigram(before, token),)

    def segment(gram):
        return _place(gram, segments)[0].astype(np.int32)

    def singles(batches):
        for b in batches:
            gram = unigram(b.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(segment(gram)), pa.array(gram.view(np.int64)), b.column("c"), pa.array(np.ones(len(gram), dtype=np.int8))], ["s", "h", "n", "b"])

    grams = _counted(rows, pairs, {"s": segment}, "s int, h long, n long, b byte").unionByName(vocabulary.mapInArrow(trimmed(singles), "s int, h long, n long, b byte"))
    summed = grams.repartition(_parts(spark, segments), "s").groupBy("s", "h", "b").agg(F.sum("n").alias("n"))

    def build(batches):
        made: dict[int, np.ndarray] = {}
        different = 0
        for b in batches:
            gram, n, seg = (b.column(c).to_numpy() for c in ("h", "n", "s"))
            gram, level = gram.view(np.uint64), level_of(n)
            different += int((b.column("b").to_numpy() == 0).sum())
            for s in np.unique(seg):
                bits = made.setdefault(int(s), np.zeros(SEGMENT_BITS // 8, dtype=np.uint8))
                own = np.flatnonzero(seg == s)
                g, lev = gram[own], level[own]
                _, base = _place(g, segments)
                for j in range(1, int(lev.max(initial=0)) + 1):
                    go = lev >= j
                    for bit in _bits(g[go], j):
                        at = base[go] + bit
                        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([different.to_bytes(8, "little")], pa.binary())], ["s", "bits"])
        for s, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["s", "bits"])

    made = scratch.cut(summed.mapInArrow(trimmed(build), "s int, bits binary"), "filter")
    whole = segments * SEGMENT_BITS <= FILTER_BITS
    bits, different = np.zeros(segments * SEGMENT_BITS // 8, dtype=np.uint8) if whole else None, 0
    for row in (made if whole else made.filter("s < 0")).toLocalIterator():  # FILTER_BITS in all
        if row["s"] < 0:
            different += int.from_bytes(row["bits"], "little")
        else:
            at = row["s"] * SEGMENT_BITS // 8
            bits[at : at + SEGMENT_BITS // 8] |= np.frombuffer(row["bits"], dtype=np.uint8)
    if whole:
        scratch.drop("filter")
    scratch.sweep()
    model = Model(bits, segments, tokens, kinds, different / tokens if tokens else 1.0)
    return Trained(model, None if whole else made.filter("s >= 0"), vocabulary, head, least)


def _parts(spark, segments: int) -> int:
    """Partitions by segment: a task's share of the filter doesn't grow with the filter."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments // GROUP))


def _chunks(rows: DataFrame, kind: str) -> DataFrame:
    """rows (k, held_out, t) with a block of texts to a row: q, and lists k, held_out and t."""

    def work(batches):
        q = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, off = text_buffer(batch.column("t"))
            for i, j in blocks(off):
                lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(c).slice(i, j - i)) for c in ("k", "held_out", "t")]
                yield pa.RecordBatch.from_arrays([pa.array([q]), *lists], ["q", "k", "held_out", "t"])
                q += 1

    return rows.mapInArrow(trimmed(work), f"q long, k array<{kind}>, held_out array<boolean>, t array<string>")


def _answers(chunks: DataFrame, segments: int, made: DataFrame) -> DataFrame:
    """q and ``levels``, the list of (g, bits): levels of the chunk's probed grams of group g of segments, a byte for each.

    A group's segments come before the grams that ask for them, so a task holds the bits of one group at a time.
    """
    spark = chunks.sparkSession

    def ask(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                data, off = text_buffer(batch.column("t").slice(r, 1).flatten())
                token, before, _ = sequences(data, off)
                gram = probed(token, before)
                group = _place(gram, segments)[0] // GROUP
                order = np.argsort(group, kind="stable")
                gram, (own, at) = gram[order], np.unique(group[order], return_index=True)
                asked = [g.tobytes() for g in np.split(gram, at[1:])]
                m, q = len(own), batch.column("q")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(m, -1), pa.int32()), pa.array(np.full(m, q), pa.int64()), pa.array(asked, pa.binary())], ["g", "s", "q", "bits"])

    def answer(batches):
        held, bits = -1, None
        for batch in batches:
            out = []
            for g, s, q, data in zip(*(batch.column(c).to_pylist() for c in ("g", "s", "q", "bits")), strict=True):
                if g != held:
                    held, bits = g, np.zeros(GROUP * SEGMENT_BITS // 8, dtype=np.uint8)
                if s >= 0:
                    at = (s - g * GROUP) * SEGMENT_BITS // 8
                    bits[at : at + SEGMENT_BITS // 8] |= np.frombuffer(data, dtype=np.uint8)
                else:
                    gram = np.frombuffer(data, dtype=np.uint64)
                    out.append((q, g, probe(bits, segments, gram, g * GROUP).astype(np.int8).tobytes()))
            if out:
                q, g, levels = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(g, pa.int32()), pa.array(levels, pa.binary())], ["q", "g", "bits"])

    asked = chunks.select("q", "t").mapInArrow(trimmed(ask), "g int, s int, q long, bits binary")
    held = made.select(F.floor(F.col("s") / GROUP).cast("int").alias("g"), "s", F.lit(-1).cast("long").alias("q"), "bits")
    both = held.unionByName(asked).repartition(_parts(spark, segments), "g").sortWithinPartitions("g", F.col("s") < 0)
    answers = both.mapInArrow(trimmed(answer), "q long, g int, bits binary")
    return answers.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("g", "bits"))).alias("levels"))


def log_probability(model: Model, token: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of each token's smoothed probability after the token before it."""
    if not len(token):
        return np.zeros(0)
    both, of = np.unique(np.concatenate([token, before]), return_inverse=True)
    count = _MEAN[model.level(unigram(both))]
    # What stands before the first word is as frequent as the end of a text.
    count[both == BEGIN] = count[both == END] if (both == END).any() else 0
    c, w = count[of[len(token) :]], count[of[: len(token)]]
    low = (w + 1) / (model.tokens + model.kinds + 1)
    seen = np.minimum(_MEAN[model.level(bigram(before, token))], c)
    return np.log10(np.where(c > 0, (seen + model.novelty * c * low) / np.maximum(c * (1 + model.novelty), 1e-9), low))


def score(docs: DataFrame, training: DataFrame, held_out, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Null texts count as empty: one token, the end.  Without training rows every count is 0, as are N and V.  Rows keep
    their number; repeated rows are scored alike, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    trained = train(training, scratch, text)
    model, made, least, vocabulary = trained.model, trained.made, trained.least, trained.vocabulary
    tokens, kinds, segments, novelty = model.tokens, model.kinds, model.segments, model.novelty
    shared = flat_broadcast(spark, model.bits if made is None else np.zeros(0, dtype=np.uint8))
    shared_head = spark.sparkContext.broadcast(trained.head)  # HEAD words at most
    del trained, model
    rows = docs.select(F.col(key).alias("k"), held_out.alias("held_out"), F.col(text).cast("string").alias("t"))

    def scored(model, part, data, off, row):
        """Rows of some texts, and of their words outside the head."""
        token, before, doc = sequences(data, off)
        n = len(off) - 1
        distinct, of = np.unique(token, return_inverse=True)
        exact = shared_head.value.known(distinct)[of]
        head = exact >= 0
        add = lambda w: np.bincount(doc, weights=w, minlength=n)
        sums = add(np.where(head, np.log10(np.maximum(exact, 0) + 1), 0))
        lm = add(log_probability(model, token, before))
        ids = np.arange(row, row + n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), part.column("k"), part.column("held_out"), pa.array(mix(ids.astype(np.uint64)).view(np.int64)), pa.array(np.bincount(doc, minlength=n)), pa.array(add(head).astype(np.int64)), pa.array(sums), pa.array(lm)],
            NAMES,
        )
        # Words outside the head, once for each text.
        tail = np.flatnonzero(~head)
        if not len(tail):
            return
        order = tail[np.lexsort((of[tail], doc[tail]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(order)))
        some, m = order[at], len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc[some]]), pa.nulls(m, part.column("k").type), pa.nulls(m, pa.bool_()), pa.array(token[some].view(np.int64)), pa.nulls(m, pa.int64()), pa.array(times), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
            NAMES,
        )

    def work(batches):
        row = TaskContext.get().partitionId() << 40
        model = Model(flat_view(shared), segments, tokens, kinds, novelty)
        for batch in batches:
            data, off = text_buffer(batch.column("t"))
            for i, j in blocks(off):
                yield from scored(model, batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], row + i)
            row += batch.num_rows

    def work_answered(batches):
        row = TaskContext.get().partitionId() << 40
        model = Model(None, segments, tokens, kinds, novelty)
        for batch in batches:
            for r in range(batch.num_rows):
                part = pa.RecordBatch.from_arrays([batch.column(c).slice(r, 1).flatten() for c in ("k", "held_out", "t")], ["k", "held_out", "t"])
                data, off = text_buffer(part.column("t"))
                token, before, _ = sequences(data, off)
                gram = probed(token, before)
                levels = np.empty(len(gram), dtype=np.int64)
                order = np.argsort(_place(gram, segments)[0] // GROUP, kind="stable")
                levels[order] = np.frombuffer(b"".join([a["bits"] for a in batch.column("levels")[r].as_py()]), dtype=np.int8)
                yield from scored(Answered(model, gram, levels), part, data, off, row)
                row += part.num_rows

    kind = rows.schema["k"].dataType.simpleString()
    columns = f"r long, k {kind}, held_out boolean, h long, n_tokens long, m long, base double, lm double"
    if made is None:
        found = rows.mapInArrow(trimmed(work), columns)
    else:
        chunks = scratch.cut(_chunks(rows, kind), "chunks")
        found = chunks.join(_answers(chunks, segments, made), "q", "left").mapInArrow(trimmed(work_answered), columns)
    # Written, so that the model needn't stay in executors' memory for as long as the result lives.
    found = scratch.cut(found, "found")
    scratch.drop("filter", "chunks")
    shared.destroy()
    shared_head.destroy()
    scratch.sweep()
    rare = vocabulary.filter(F.col("c") < least)
    joined = found.join(rare, "h", "left")
    whole = F.col("n_tokens").isNotNull()
    known = F.when(whole, F.col("m")).otherwise(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0))
    base = F.when(whole, F.col("base")).otherwise(F.col("m") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1))
    sums = joined.groupBy("r").agg(F.max("k").alias(key), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base"), F.sum("lm").alias("score"))
    return sums.select(
        key,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"),
        "score",
    )


NAMES = ["r", "k", "held_out", "h", "n_tokens", "m", "base", "lm"]


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores all documents, learning from those whose crc32(doc_id) mod 7 is not 2."""
    held = crc_mod(7) == 2
    return score(docs, docs.filter(~held), held)
