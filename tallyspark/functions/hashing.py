"""Hashes of keys as Spark columns.

A key is read as the UTF-8 bytes of its string (binary keys as they are). A hash is 64 bits, carried as two numbers of 32
bits, ``hi`` and ``lo``, since Spark's integers are signed and refuse to overflow. ``md5`` is the same in any SQL,
``xxhash64`` is the fastest in Spark, ``xxh3`` (Arrow UDF) is the one whose structures other programs share.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
MASK64 = (1 << 64) - 1


def key_bytes(key: Column) -> Column:
    """Keys as binary: the UTF-8 bytes of the string form."""
    return F.encode(key.cast("string"), "UTF-8")


def shl(x: Column, n: Column) -> Column:
    """Shift left by a column."""
    return F.call_function("shiftleft", x, n.cast("int"))


def shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def shru(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def whole(n: int) -> Column:
    """A literal that may be beyond 64 bits."""
    return F.lit(Decimal(n))


def _hex(h: Column, at: int, n: int = 8) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10)


def md5_words(key: Column, first: int = 0) -> tuple[Column, Column]:
    """(hi, lo): the two 32-bit words of the MD5 of the key that begin at word ``first``."""
    h = F.md5(key_bytes(key))
    return _hex(h, first * 8 + 1).cast("long"), _hex(h, first * 8 + 9).cast("long")


def hex_digest(raw: Column) -> Column:
    """Bytes in upper-case hexadecimal."""
    return F.upper(F.hex(raw))


def _split(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(MASK32).cast("long"))


def xxhash64_words(key: Column) -> tuple[Column, Column]:
    return _split(F.xxhash64(key.cast("string")))


def xxh3(seed: int = 0) -> Callable[[Column], Column]:
    """XXH3 of 64 bits as a signed long."""

    @F.pandas_udf("long")
    def udf(s):  # noqa: ANN001, ANN202
        of = xxhash.xxh3_64_intdigest
        return s.map(lambda x: np.uint64(of(x, seed)).astype(np.int64), na_action="ignore").astype("Int64")

    return lambda key: udf(key_bytes(key))


def xxh3_words(key: Column) -> tuple[Column, Column]:
    return _split(xxh3()(key))


HASHES: dict[str, Callable[[Column], tuple[Column, Column]]] = {"md5": md5_words, "xxhash64": xxhash64_words, "xxh3": xxh3_words}


def words(key: Column, hash_name: str) -> tuple[Column, Column]:
    if hash_name not in HASHES:
        raise ValueError(f"unknown hash {hash_name!r}; register it in HASHES first")
    return HASHES[hash_name](key)


def top_bits(hi: Column, lo: Column, bits: int) -> Column:
    """The first ``bits`` (at most 62) bits of a hash as a number."""
    if bits <= 32:
        return F.shiftright(hi, 32 - bits)
    return F.shiftleft(hi, bits - 32).bitwiseOR(F.shiftright(lo, 64 - bits))


def leading_zeros(hi: Column, lo: Column) -> Column:
    """Of the 64 bits."""
    return 64 - F.when(hi > 0, 32 + F.length(F.bin(hi))).when(lo > 0, F.length(F.bin(lo))).otherwise(0)


def unsigned(h: Column) -> Column:
    """A signed long read as an unsigned number."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + whole(1 << 64).cast("decimal(20,0)")).otherwise(d)


# In Python, for folds that go key by key


def xxh3_64(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed)


def mix64(x: int) -> int:
    """MurmurHash3's 64-bit finaliser."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK64
    return x ^ x >> 33


class SplitMix64:
    """Vigna's generator: one 64-bit state."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK64

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK64
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK64
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() * n >> 64

    def unit(self) -> float:
        """In [0, 1), by 53 bits."""
        return (self.next() >> 11) * 2.0**-53
