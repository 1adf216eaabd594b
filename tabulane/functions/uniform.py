"""Reproducible uniforms: a pure function of (seed, column, draw number, key).

The value does not depend on partitioning, order or retries, unlike a generator with state. A key
that is NULL gives NULL. Two hashes are offered: "md5", which any SQL engine can repeat, and
"xxhash64", which is some twenty times cheaper per draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("md5", "xxhash64")
HEX_DIGITS = 13  # 13 hex digits = 52 bits
STARTS = (1, 17)  # an md5 serves two draws: even ones read its first half, odd ones its second


def draw_hash(seed: int, name: str, draw: int, key: Column, hashing: str = "md5") -> Column:
    """The hash behind draw number `draw`; with md5 the next draw shares it."""
    if hashing == "md5":
        return F.md5(F.concat(F.lit(f"{seed}|{name}|{draw // 2}|"), key.cast("string")))
    if hashing == "xxhash64":
        return F.when(key.isNotNull(), F.xxhash64(F.lit(f"{seed}|{name}|{draw}"), key))
    raise ValueError(f"unknown hash '{hashing}'; use one of {', '.join(HASHES)}")


def hash_group(draw: int, hashing: str = "md5") -> int:
    """Draws with the same group read the same hash."""
    return draw // 2 if hashing == "md5" else draw


def bits_of(value: Column, draw: int, hashing: str = "md5") -> Column:
    """52 bits of a hash as a long."""
    if hashing == "md5":
        return F.conv(F.substring(value, STARTS[draw % 2], HEX_DIGITS), 16, 10).cast("long")
    return F.shiftrightunsigned(value, 12)


def unit_of(bits: Column) -> Column:
    """Bits to the open interval (0, 1)."""
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def uniform(seed: int, name: str, draw: int, key: Column, hashing: str = "md5") -> Column:
    """Uniform in the open interval (0, 1)."""
    return unit_of(bits_of(draw_hash(seed, name, draw, key, hashing), draw, hashing))
