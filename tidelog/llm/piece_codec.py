"""SentencePiece encoding and decoding with original byte spans.

Text is normalised by longest-prefix search in the model's compiled character map.  The search records,
for every byte that it writes, the byte of the original text that it came from, and each piece is
projected through that alignment to a span of original bytes.

Merging itself is the library's, on the normalised text.  Where the vocabulary proves that no piece crosses the start of a run of
spaces (no piece has a space after another character), texts are encoded segment by segment and repeated
segments are looked up; otherwise whole texts are passed to the library, which normalises as the search does.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import trimmed

SPACE_MARK = "\u2581"
#: Segments remembered in a worker; the memory is emptied when full.
MEMO = 300_000


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (buf[i] & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if buf[i - 1] < 0x80:
            return out, i


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    i = 0
    while i < len(buf):
        tag, i = _varint(buf, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(buf, i)
        elif kind == 2:
            n, i = _varint(buf, i)
            value, i = buf[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = buf[i : i + n], i + n
        yield tag >> 3, value


class Normaliser:
    """Longest-prefix normalisation by a compiled character map, with source alignment.

    The map is a double-array trie over UTF-8 keys, whose values are places in a table of replacements that end in
    a zero byte.
    """

    def __init__(self, spec: bytes, whitespace_suffix: bool = False):
        opts = {3: 1, 4: 1, 5: 1}
        charsmap = b""
        for field, value in _fields(spec):
            if field == 2:
                charsmap = value
            elif field in opts:
                opts[field] = value
        self.dummy, self.squeeze, self.escape = (bool(opts[k]) for k in (3, 4, 5))
        self.suffix = whitespace_suffix
        self.units, self.table = np.empty(0, dtype=np.uint32), b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = np.frombuffer(charsmap, dtype="<u4", count=size // 4, offset=4).tolist()
            self.table = charsmap[4 + size :]

    @property
    def identity(self) -> bool:
        return not len(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.table.index(b"\0", found[1])
        return found[0], self.table[found[1] : end]

    def _steps(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(place, consumed bytes, replacement), one for each longest match or unmatched character."""
        i = 0
        while i < len(text):
            hit = self.longest(text, i)
            if hit is None:
                lead = text[i]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, text[i : i + n]
            yield i, hit[0], hit[1]
            i += hit[0]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for the end, the original byte that it came from."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        mark = SPACE_MARK.encode() if self.escape else b" "
        if self.identity and not self.squeeze and not self.suffix:
            data = np.frombuffer(raw, dtype=np.uint8)
            width = np.where(data == 0x20, len(mark), 1)
            head = len(mark) * self.dummy
            align = np.concatenate([np.zeros(head, dtype=np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
            return mark * self.dummy + raw.replace(b" ", mark), align
        steps = [(i, n, r) for i, n, r in (self._steps(raw) if not self.identity else self._plain(raw))]
        k = 0
        if self.squeeze:
            while k < len(steps) and steps[k][2] == b" ":
                k += 1
            if k == len(steps):
                return b"", np.array([len(raw)])
        out, align = bytearray(), []
        at = steps[k][0]
        if self.dummy and not self.suffix:
            out += mark
            align += [at] * len(mark)
        blank = self.squeeze
        for i, n, r in steps[k:]:
            while blank and r.startswith(b" "):
                r = r[1:]
            for byte in r:
                piece = mark if byte == 0x20 else bytes([byte])
                out += piece
                align += [i] * len(piece)
            if r:
                blank = r.endswith(b" ")
            at = i + n
            blank = blank and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                at = align[len(out) - len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        if self.dummy and self.suffix:
            out += mark
            align += [at] * len(mark)
        return bytes(out), np.array([*align, at], dtype=np.int64)

    @staticmethod
    def _plain(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        for m in re.finditer(rb"[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*", raw):
            yield m.start(), m.end() - m.start(), m[0]


class PieceCodec:
    """Encodes as the library does, without begin or end ids, and knows each piece's original bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor()
        self.lib.LoadFromSerializedProto(model)
        pieces, kinds, spec, suffix = [], [], b"", False
        for field, value in _fields(model):
            if field == 1:
                sub = dict(_fields(value))
                pieces.append(sub.get(1, b"").decode())
                kinds.append(sub.get(3, 1))
            elif field == 2:
                suffix = bool(dict(_fields(value)).get(24, 0))
            elif field == 3:
                spec = value
        self.normaliser = Normaliser(spec, suffix)
        # Kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte.
        self.width = [1 if k == 6 else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)]
        self.unknown = {i for i, k in enumerate(kinds) if k == 2}
        plain = [p for p, k in zip(pieces, kinds, strict=True) if k == 1]
        n = self.normaliser
        self.by_segment = n.identity and n.dummy and n.escape and not n.squeeze and not n.suffix and 4 not in kinds and 6 in kinds and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in plain)
        # A line end that no piece contains stands alone.
        self.line_alone = self.by_segment and not any("\n" in p for p in plain)
        self.segment = re.compile(r" *[^ \n]+| +|\n" if self.line_alone else r" *[^ ]+| +").findall
        self.stop = "\n"
        self.stop_ids = len(self.lib.encode(self.stop)) - 1
        self.opens = np.array([p.startswith(SPACE_MARK) for p in pieces])
        self.names = [str(i) for i in range(len(pieces))]
        self.memo: dict[str, tuple] = {}

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that aren't known; what is added to pass one alone is taken off again."""
        if len(self.memo) + len(segments) > MEMO:
            self.memo.clear()
        # One space and a word: such segments are passed as one text, whose pieces that open with the mark begin them.
        words = [s for s in segments if s[0] == " " and s[1:2] not in ("", " ")]
        if words:
            ids = self.lib.encode("".join(words)[1:])
            cuts = np.flatnonzero(self.opens[ids]).tolist()
            if len(cuts) != len(words):
                raise ValueError("a piece crosses the start of a word")
            for s, i, j in zip(words, cuts, [*cuts[1:], len(ids)], strict=True):
                self._keep(s, ids[i:j])
        others = [s for s in segments if s[0] != " " or s[1:2] in ("", " ")]
        for s in others:
            if s[0] != " ":
                self._keep(s, self.lib.encode("\n" + s)[2:])  # begins after a line end: the mark and the line end come first
            elif s.strip(" "):
                self._keep(s, self.lib.encode(s[1:]))  # the library puts one mark before the text
            else:
                self._keep(s, self.lib.encode(s[1:] + self.stop)[: -self.stop_ids])

    def _keep(self, segment: str, ids: list[int]) -> None:
        self.memo[segment] = ids, bytes([self.width[i] for i in ids]), ",".join([self.names[i] for i in ids])

    def parts(self, norm: str) -> list[tuple]:
        """(ids, normalised widths, ids as text) of each segment of a normalised text."""
        segments = self.segment(norm.replace(SPACE_MARK, " "))
        memo = self.memo
        try:
            return [memo[s] for s in segments]
        except KeyError:
            distinct = dict.fromkeys(segments)
            new = [s for s in distinct if s not in memo]
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(distinct)
            for i in range(0, len(new), MEMO // 4):
                self._learn(new[i : i + MEMO // 4])
            return [memo[s] for s in segments] if len(new) <= MEMO else self._long(segments)

    def _long(self, segments: list[str]) -> list[tuple]:
        """As ``parts``, for a text with more different segments than are remembered."""
        out: list[tuple] = []
        for i in range(0, len(segments), MEMO // 4):
            some = segments[i : i + MEMO // 4]
            self.memo.clear()
            self._learn(list(dict.fromkeys(some)))
            out += [self.memo[s] for s in some]
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray, str]:
        """Ids, their (begin, end) in the original UTF-8 bytes, and the ids joined by commas."""
        norm, align = self.normaliser.normalise(text)
        if self.by_segment:
            got = self.parts(norm.decode())
            ids = list(chain.from_iterable([p[0] for p in got]))
            width = np.frombuffer(b"".join([p[1] for p in got]), dtype=np.uint8)
            listed = ",".join([p[2] for p in got])
        else:
            ids = self.lib.encode(text)
            width, at = [], 0
            for i, piece in zip(ids, self.lib.encode(text, out_type=str), strict=True):
                width.append(len(piece.encode()) if i in self.unknown else self.width[i])
                at += width[-1]
            listed = ",".join(map(str, ids))
        ends = np.cumsum(np.asarray(width, dtype=np.int64))
        if (ends[-1] if len(ends) else 0) != len(norm):
            raise ValueError("pieces don't cover the normalised text")
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, np.stack([align[begins], align[ends]], axis=1) if len(ends) else np.empty((0, 2), dtype=np.int64), listed

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("t").to_pylist()]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids, begins, ends (original UTF-8 byte spans), n_tokens, ids_sha256, decoded_sha256 of each row.

    Null texts count as empty and give empty lists.  Rows keep their number; repeated rows are encoded alike, an
    empty table gives an empty result, other columns are ignored.  Whole texts are encoded, however long.
    """
    return _run(docs, model_path, text, key, ("ids", "begins", "ends"))


def encode_ids(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_documents``, without the spans."""
    return _run(docs, model_path, text, key, ("ids",))


def encode_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_documents``, with spans_sha256 in the place of the lists: the digest of all pieces' begins and ends
    in the original bytes, each as four bytes, little-endian."""
    return _run(docs, model_path, text, key, (), True)


def _run(docs: DataFrame, model_path: str, text: str, key: str, lists: tuple, digest: bool = False) -> DataFrame:
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file; its size doesn't depend on the data
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def work(batches):
        codec = None
        for batch in batches:
            codec = codec or PieceCodec(model.value)
            out = {"ids": [], "begins": [], "ends": [], "n": [], "i": [], "d": [], "s": []}
            for t in _texts(batch):
                ids, spans, listed = codec.encode(t)
                back = codec.decode(ids) if ids else ""
                out["n"].append(len(ids))
                out["i"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["d"].append(hashlib.sha256(back.encode()).hexdigest())
                if digest:
                    out["s"].append(hashlib.sha256(spans.astype("<i4").tobytes()).hexdigest())
                if lists:
                    each = {"ids": ids, "begins": spans[:, 0], "ends": spans[:, 1]}
                    for c in lists:
                        out[c].append(np.array(each[c], dtype=np.int32))
            cols = [batch.column("k"), *(pa.array(out[c], type=pa.list_(pa.int32())) for c in lists), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
            names = ["k", *lists, "n_tokens", "ids_sha256", "decoded_sha256"]
            if digest:
                cols.append(pa.array(out["s"], pa.string()))
                names.append("spans_sha256")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"k {kind}, " + "".join(f"{c} array<int>, " for c in lists) + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", spans_sha256 string" * digest
    return rows.mapInArrow(trimmed(work), schema).withColumnRenamed("k", key)
