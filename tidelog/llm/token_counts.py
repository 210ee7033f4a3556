"""Token counts by overlap resynchronisation.

Short texts are counted by the library, each distinct word once where no token crosses white space.  A text longer
than a chunk is cut into overlapping chunks that are encoded with offsets.  Two neighbours
are spliced at a place in their overlap where a token of both ends and another of both begins, with white
space between, which no token of the supported vocabularies crosses; the tokens around it must agree.
Where an overlap has no such place it is widened, in the end over the whole rest.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, trimmed

#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Tokens on each side of a splice that both encodings must agree on, as far as the overlap has them.
AGREE = 4
#: Words remembered in a worker; the memory is emptied when full.
MEMO = 600_000


class Spans:
    """An encoding as the list of its tokens' (begin, end), ``at`` characters into the text."""

    def __init__(self, spans: list[tuple[int, int]], at: int):
        self.spans = [(a + at, b + at) for a, b in spans]
        self.begins = [a for a, _ in self.spans]

    def count(self, lo: int, hi: int) -> int:
        return bisect_left(self.begins, hi) - bisect_left(self.begins, lo)

    def around(self, cut: int) -> tuple[list, list]:
        i = bisect_left(self.begins, cut)
        return self.spans[max(0, i - AGREE) : i], self.spans[i : i + AGREE]


class JsonTokenizer:
    """A tokenizers file; words between ASCII white space are encoded once where its pattern can't cross that."""

    splice = re.compile(r"(?<=[^\s])[ \t-\r]")

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_str(model.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        config = json.loads(model)
        self.by_word = _drops_space(config)
        self.lowers = self.by_word and "Lowercase" in json.dumps(config.get("normalizer"))
        added = "|".join(re.escape(t["content"]) for t in config.get("added_tokens", []) if t["content"])
        self.added = re.compile(added, re.IGNORECASE) if added else None  # matched on the raw text, so case must stay
        self.words = re.compile(r"[^ \t-\r]+")
        self.memo: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        """Counts of new words."""
        memo, asked = self.memo, []
        for w in words:
            fold = self.lowers and w.isascii() and not (self.added and self.added.search(w))
            asked.append((w, w.lower() if fold else w))
        ask = list({a for _, a in asked}.difference(memo))
        memo.update(zip(ask, map(len, self.lib.encode_batch_fast(ask, add_special_tokens=False)), strict=True))
        for w, a in asked:
            memo[w] = memo[a]

    def known(self, words: list[str]) -> list[int]:
        """The number of tokens of each word."""
        out = []
        for k in range(0, len(words), MEMO // 8):
            some = words[k : k + MEMO // 8]
            self._ready(set(some))
            out += map(self.memo.__getitem__, some)
        return out

    def _ready(self, words: set[str]) -> None:
        new = words.difference(self.memo)
        if len(self.memo) + 2 * len(new) > MEMO:
            self.memo.clear()
            new = words
        if new:
            self._learn(new)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        out, get = [], self.memo.__getitem__
        ends = np.cumsum([len(t) for t in texts])
        for i, j in blocks(np.concatenate([[0], ends]), MEMO // 2):  # so many characters have fewer words
            lists = [self.words.findall(t) for t in texts[i:j]]
            if j - i == 1:
                out.append(sum(self.known(lists[0])))
                continue
            self._ready(set().union(*lists))
            out += [sum(map(get, words)) for words in lists]
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def encode(self, text: str, at: int) -> Spans:
        return Spans(self.lib.encode(text, add_special_tokens=False).offsets, at)


def _drops_space(config: dict) -> bool:
    """Whether white space always ends a token and changes none: the pattern's matches can't hold white space, and normalising is by character."""
    norm = config.get("normalizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    for n in norms:
        if not (n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    pre = config.get("pre_tokenizer") or {}
    first, *rest = pre.get("pretokenizers", [pre])
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(r["type"] != "ByteLevel" or r["add_prefix_space"] or r["use_regex"] for r in rest):
        return False
    pattern = first["pattern"].get("Regex", " ")
    outside = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)  # a class that excludes white space
    if re.search(r"\\[sSDWPB]|\(|\.|[ \t-\r]|\[\^", outside):
        return False
    return not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config.get("added_tokens", []))


class PieceTokenizer:
    """A sentencepiece model; a run of spaces after another character begins a piece."""

    def __init__(self, model: bytes):
        from tidelog.llm.piece_codec import PieceCodec

        self.codec = PieceCodec(model)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.codec.by_segment:
            return [len(ids) for ids in self.codec.lib.encode(texts, num_threads=1)]
        return [sum([len(p[0]) for p in self.codec.parts(" " + t)]) if t else 0 for t in texts]

    def encode(self, text: str, at: int) -> Spans:
        first = at == 0
        parts = self.codec.parts((" " if first else "") + text)
        width = np.frombuffer(b"".join([p[1] for p in parts]), dtype=np.uint8).astype(np.int64)
        norm = (" " if first else "") + text.replace("\u2581", " ")
        chars = np.repeat(np.arange(len(norm)), [3 if c == " " else len(c.encode()) for c in norm])
        chars = np.maximum(np.append(chars, len(norm)) - first, 0)
        end = np.cumsum(width)
        return Spans(list(zip(chars[end - width].tolist(), chars[end].tolist(), strict=True)), at)

    splice = re.compile(r"(?<=[^ \n\u2581]) (?=[^ \n])")


def tokenizer(path: str, model: bytes):
    return JsonTokenizer(model) if path.endswith(".json") else PieceTokenizer(model)


def resynchronise(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, stats: dict | None = None) -> int:
    """The number of tokens of a text that is longer than a chunk."""
    total = left = start = 0  # tokens before ``left`` are counted; ``start`` is where the current chunk begins
    stop = min(chunk, len(text))
    one = tok.encode(text[:stop], 0)
    while stop < len(text):
        width, place = overlap, None
        while place is None:
            begin = max(start, stop - width)
            cuts = [m.start() for m in tok.splice.finditer(text, max(begin, 1), stop)]
            # The next chunk begins at the first place, so that it opens as the text goes on there.
            if cuts:
                end = min(len(text), cuts[0] + max(chunk, 2 * width))
                two = tok.encode(text[cuts[0] : end], cuts[0])
                place = _common(one, two, cuts[1:], stop)
            if place is not None:
                break
            if stats is not None:
                stats["widened"] = stats.get("widened", 0) + 1
            if begin <= start:
                # No stable place in the whole chunk: encode it again together with all the rest.
                return total + tok.encode(text[start:], start).count(left, len(text))
            width *= 4
        total += one.count(left, place)
        start, left, one, stop = cuts[0], place, two, end
    return total + one.count(left, len(text))


def _common(one, two, cuts: list[int], stop: int) -> int | None:
    """The last place where a token ends in both encodings, and the tokens around it agree."""
    for cut in reversed(cuts):
        before, after = one.around(cut)
        before_two, after_two = two.around(cut)
        if not before or not before_two or before[-1][1] != cut:
            continue
        m = min(len(before), len(before_two))
        # The end of the first chunk may cut a token.
        whole = [t for t in after if t[1] < stop]
        if before[-m:] == before_two[-m:] and whole and whole == after_two[: len(whole)]:
            return cut
    return None


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row, as the file's library counts the whole text.

    Null texts count as empty; a text of any length is encoded whole, chunk by chunk.  Rows keep their number, repeated rows are counted alike, an empty table gives an
    empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file; its size doesn't depend on the data
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def work(batches):
        tok = None
        for batch in batches:
            tok = tok or tokenizer(path, model.value)
            texts = [t or "" for t in batch.column("t").to_pylist()]
            short = iter(tok.counts([t for t in texts if len(t) <= chunk]) if any(len(t) <= chunk for t in texts) else ())
            counts = [next(short) if len(t) <= chunk else resynchronise(tok, t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(counts, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], ["k", "n_tokens", "n_bytes"])

    out = rows.mapInArrow(trimmed(work), f"k {rows.schema['k'].dataType.simpleString()}, n_tokens long, n_bytes long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
