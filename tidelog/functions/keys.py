"""Byte-string codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_key(number: Column) -> Column:
    """Eight bytes, most significant first: byte order is numeric order for numbers >= 0."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def be_number(key: Column) -> Column:
    return F.conv(F.hex(key), 16, -10).cast("long")


def _swap(hexed: Column, width: int) -> Column:
    return F.concat(*(F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(width))))


def le_fixed(number: Column, width: int) -> Column:
    """``width`` bytes, least significant first (1, 2, 4 or 8)."""
    return F.unhex(_swap(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * width)), width))


def le_fixed128(high: Column, low: Column) -> Column:
    return F.concat(le_fixed(low, 8), le_fixed(high, 8))


def turned(data: Column, width: int) -> Column:
    """The first ``width`` bytes in the opposite order, with zeros for those that are lacking."""
    return F.unhex(F.lpad(_swap(F.hex(F.substring(data, 1, width)), width), 2 * width, "0"))


def pointer(file: Column, offset: Column) -> Column:
    """Sixteen bytes that name a value: its file's number and its place there, little-endian."""
    return F.concat(le_fixed(file, 8), le_fixed(offset, 8))


def pointer_file(data: Column) -> Column:
    return F.when(F.octet_length(data) == 16, le_number(data, 8))


def pointer_offset(data: Column) -> Column:
    return F.when(F.octet_length(data) == 16, le_number(F.substring(data, 9, 8), 8))


def le_number(data: Column, width: int) -> Column:
    """The number in the first ``width`` bytes; eight bytes are read as signed."""
    return F.conv(_swap(F.hex(F.substring(data, 1, width)), width), 16, -10).cast("long")


def internal_key(user_key: Column, seq: Column, kind: Column) -> Column:
    """user key, then the sequence number shifted over the kind, little-endian."""
    return F.concat(user_key, le_fixed(F.shiftleft(seq, 8).bitwiseOR(kind.cast("long")), 8))


def internal_user_key(data: Column) -> Column:
    return F.substring(data, F.lit(1), F.octet_length(data) - 8)


def internal_seq(data: Column) -> Column:
    return F.shiftrightunsigned(_tail(data), 8)


def internal_kind(data: Column) -> Column:
    return _tail(data).bitwiseAND(F.lit(0xFF)).cast("byte")


def _tail(data: Column) -> Column:
    return le_number(F.substring(data, F.octet_length(data) - 7, F.lit(8)), 8)


def without_prefix(data: Column, n: int) -> Column:
    return F.substring(data, F.lit(n + 1), F.greatest(F.octet_length(data) - n, F.lit(0)))


def starts_with(data: Column, prefix: Column) -> Column:
    return F.substring(data, F.lit(1), F.octet_length(prefix)) == prefix
