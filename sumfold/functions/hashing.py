"""The only place with hash expressions.

Everything hashes sha256 of the value's text, so any engine with sha256 gets the same
cells. Hash bigint and string columns only: the text of other types differs by engine.
64-bit hashes are kept as two 32-bit halves, which stay in signed bigints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32


def digest(item: Column) -> Column:
    """sha256 of the value as text, in hex."""
    return F.sha2(item.cast("string"), 256)


def seeded_digest(seed, item: Column) -> Column:
    """sha256 of `seed:value`."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.sha2(F.concat_ws(":", seed.cast("string"), item.cast("string")), 256)


def high(hexed: Column) -> Column:
    """First 32 bits."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def low(hexed: Column) -> Column:
    """Next 32 bits."""
    return F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long")


def modulo(hexed: Column, m: int) -> Column:
    """The unsigned 64-bit hash mod m, for m below 2**31."""
    if not 0 < m < 1 << 31:
        raise ValueError("m must be in 1 .. 2**31 - 1")
    return F.pmod(F.pmod(high(hexed), F.lit(m)) * F.lit(WORD % m) + low(hexed), F.lit(m))


def leading_zeros(hexed: Column) -> Column:
    """Of the 64-bit hash."""
    hi, lo = high(hexed), low(hexed)
    return F.when(hi > 0, 32 - F.length(F.bin(hi))).when(lo > 0, 64 - F.length(F.bin(lo))).otherwise(64)


def affine32(a: Column, h: Column, b: Column) -> Column:
    """(a * h + b) mod 2**32 for values below 2**32; the product is split so that it never overflows."""
    upper = F.pmod(F.shiftright(a, 16) * h, F.lit(WORD)) * 65536
    return (upper + a.bitwiseAND(F.lit(65535)) * h + b).bitwiseAND(F.lit(WORD - 1))
