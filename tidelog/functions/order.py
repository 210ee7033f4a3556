"""Comparators as sort-key expressions, and the keys that lie between two others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import turned


class Comparator:
    """A named order: ``sort_key`` maps a key column to columns whose ascending order it is."""

    def __init__(self, name: str, sort_key: Callable[[Column], list[Column]], separator=None, successor=None):
        self.name, self.sort_key = name, sort_key
        self.separator = separator or (lambda start, limit: start)
        self.successor = successor or (lambda key: key)

    def less(self, a: Column, b: Column) -> Column:
        return F.struct(*self.sort_key(a)) < F.struct(*self.sort_key(b))

    def least(self, *keys: Column) -> Column:
        return F.reduce(F.array(*keys[1:]), keys[0], lambda best, k: F.when(self.less(k, best), k).otherwise(best))

    def greatest(self, *keys: Column) -> Column:
        return F.reduce(F.array(*keys[1:]), keys[0], lambda best, k: F.when(self.less(best, k), k).otherwise(best))

    def sort(self, df: DataFrame, key: str) -> DataFrame:
        return df.orderBy(*self.sort_key(F.col(key)))


def _byte(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")


def _raised(data: Column, i: Column) -> Column:
    """The first i bytes, the last of them plus one."""
    return F.concat(F.substring(data, F.lit(1), i - 1), F.unhex(F.lpad(F.hex(_byte(data, i) + 1), 2, "0")))


def _where(data: Column, other: Column | None) -> Column:
    """Place, from 1, of the first byte that differs from ``other``'s, or that isn't 0xff; null if there is none."""
    n = F.octet_length(data) if other is None else F.least(F.octet_length(data), F.octet_length(other))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = (lambda i: _byte(data, i) < 255) if other is None else (lambda i: F.substring(data, i, F.lit(1)) != F.substring(other, i, F.lit(1)))
    return F.get(F.filter(places, differs), F.lit(0))


def shortest_separator(start: Column, limit: Column) -> Column:
    """A short key s with start <= s < limit; start itself where none is shorter."""
    at = _where(start, limit)
    room = at.isNotNull() & (_byte(start, at) < 255) & (_byte(start, at) + 1 < _byte(limit, at))
    return F.when(room, _raised(start, at)).otherwise(start)


def short_successor(key: Column) -> Column:
    """A short key that is greater: the first byte below 0xff plus one; keys of 0xff alone stay."""
    at = _where(key, None)
    return F.when(at.isNotNull(), _raised(key, at)).otherwise(key)


BYTEWISE = Comparator("bytewise", lambda k: [k], shortest_separator, short_successor)
#: Little-endian numbers of up to eight bytes, without a sign: their bytes turned round.
NUMERIC = Comparator("numeric", lambda k: [turned(k, 8)], None, short_successor)
USER_KEY = Comparator("user_key", lambda k: [F.substring(k, F.lit(1), F.octet_length(k) - 8)])


def internal_order(key: str = "user_key", seq: str = "seq") -> list[Column]:
    """User key ascending, newest version first."""
    return [F.col(key).asc(), F.col(seq).desc()]
