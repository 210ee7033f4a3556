"""Checksums and hashes that Spark has no built-in for, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, LongType

#: Reflected Castagnoli polynomial; CCITT polynomial and start value.
CRC32C_POLY, CRC16_POLY, CRC16_START = 0x82F63B78, 0x1021, 0xFFFF


def _crc32c_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CRC32C_POLY if byte & 1 else 0)
        out.append(byte)
    return out


def _crc16_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (CRC16_POLY if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


def _columnwise(values: list, start: int, step) -> np.ndarray:
    """Checksums of many byte strings at once, one byte of each at a time, the longest first."""
    size = np.array([len(v) for v in values])
    order = np.argsort(-size, kind="stable")
    sorted_size = size[order]
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])[order]
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    state = np.full(len(values), start, dtype=np.uint32)
    for i in range(int(sorted_size[0]) if len(values) else 0):
        n = int(np.searchsorted(-sorted_size, -i, side="left"))  # those longer than i
        state[:n] = step(state[:n], data[offset[:n] + i])
    out = np.empty_like(state)
    out[order] = state
    return out


def crc32c_of(values: list) -> np.ndarray:
    table = np.array(_crc32c_table(), dtype=np.uint32)
    return ~_columnwise(values, 0xFFFFFFFF, lambda s, b: table[(s ^ b) & 0xFF] ^ (s >> np.uint32(8)))


def crc16_of(values: list, start: int = CRC16_START) -> np.ndarray:
    """``start`` may be the checksum of a prefix."""
    table = np.array(_crc16_table(), dtype=np.uint32)
    return _columnwise(values, start, lambda s, b: (table[(s >> np.uint32(8)) ^ b] ^ (s << np.uint32(8))) & np.uint32(0xFFFF))


def _of(values: pd.Series, function) -> pd.Series:
    out = pd.Series([None] * len(values), dtype="Int64")
    some = values.notna()
    out[some.to_numpy()] = function([bytes(v) for v in values[some]]).astype(np.int64)
    return out


@pandas_udf(LongType())
def crc32c(values: pd.Series) -> pd.Series:
    return _of(values, crc32c_of)


@pandas_udf(IntegerType())
def crc16(values: pd.Series) -> pd.Series:
    return _of(values, crc16_of).astype("Int32")


_MASK = (1 << 64) - 1
#: Multipliers of the 128-bit Murmur3 hash for 64-bit machines.
MURMUR_C1, MURMUR_C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotate(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _MASK


def _finish(x: int) -> int:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & _MASK
    return x ^ x >> 33


def murmur3_128(data: bytes, seed: int = 1) -> bytes:
    """Murmur3 x64 128 of a byte string, as its sixteen bytes."""
    one = two = seed
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        a, b = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        one ^= _rotate(a * MURMUR_C1 & _MASK, 31) * MURMUR_C2 & _MASK
        one = ((_rotate(one, 27) + two) * 5 + 0x52DCE729) & _MASK
        two ^= _rotate(b * MURMUR_C2 & _MASK, 33) * MURMUR_C1 & _MASK
        two = ((_rotate(two, 31) + one) * 5 + 0x38495AB5) & _MASK
    rest = data[whole:]
    two ^= _rotate(int.from_bytes(rest[8:], "little") * MURMUR_C2 & _MASK, 33) * MURMUR_C1 & _MASK
    one ^= _rotate(int.from_bytes(rest[:8], "little") * MURMUR_C1 & _MASK, 31) * MURMUR_C2 & _MASK
    one, two = one ^ len(data), two ^ len(data)
    one = (one + two) & _MASK
    two = (two + one) & _MASK
    one, two = _finish(one), _finish(two)
    one = (one + two) & _MASK
    two = (two + one) & _MASK
    return one.to_bytes(8, "little") + two.to_bytes(8, "little")


def murmur3_of(values: list, seed: int = 1) -> np.ndarray:
    """The hashes of many byte strings, two 64-bit words a row; sixteen bytes of each at a time."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    padded = -(-size // 16) * 16
    words = np.frombuffer(b"".join([bytes(v).ljust(p, b"\0") for v, p in zip(values, padded.tolist(), strict=True)]), dtype="<u8")
    first, whole = (np.cumsum(padded) - padded) // 8, size // 16
    u = np.uint64
    turn = lambda x, n: x << u(n) | x >> u(64 - n)
    c1, c2 = u(MURMUR_C1), u(MURMUR_C2)
    one, two = np.full(len(size), seed, dtype=u), np.full(len(size), seed, dtype=u)
    with np.errstate(over="ignore"):
        for i in range(int(whole.max(initial=0))):
            at = np.flatnonzero(whole > i)
            a, b = words[first[at] + 2 * i], words[first[at] + 2 * i + 1]
            x = one[at] ^ turn(a * c1, 31) * c2
            x = (turn(x, 27) + two[at]) * u(5) + u(0x52DCE729)
            y = two[at] ^ turn(b * c2, 33) * c1
            one[at], two[at] = x, (turn(y, 31) + x) * u(5) + u(0x38495AB5)
        at = np.flatnonzero(size % 16)
        a, b = words[first[at] + 2 * whole[at]], words[first[at] + 2 * whole[at] + 1]
        two[at] ^= turn(b * c2, 33) * c1
        one[at] ^= turn(a * c1, 31) * c2
        one, two = one ^ size.astype(u), two ^ size.astype(u)
        one = one + two
        two = two + one
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            one, two = ((x ^ x >> u(33)) * u(factor) for x in (one, two))
        one, two = (x ^ x >> u(33) for x in (one, two))
        one = one + two
        two = two + one
    return np.stack([one, two], axis=1)


@pandas_udf(BinaryType())
def murmur3(values: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(values), dtype=object)
    some = values.notna().to_numpy()
    if some.any():
        out[some] = [h.tobytes() for h in murmur3_of([bytes(v) for v in values[some]]).astype("<u8")]
    return out
