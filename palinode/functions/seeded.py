"""Deterministic pseudo-random columns.

Every draw is an md5 of (seed, keys...), so a result depends only on the data, never on partitioning,
retries or the engine, and any SQL engine with md5 can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 2**32


def seed_key(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits; sorting by it is a seeded shuffle."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hex_u32(hex_digits: Column) -> Column:
    """First 32 bits of a hex digest as LONG."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long")


def seed_u32(seed: int | str, *keys: Column | str) -> Column:
    return hex_u32(seed_key(seed, *keys))


def seed_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return seed_u32(seed, *keys) / F.lit(float(U32))


def seed_pick(n: Column | int, seed: int | str, *keys: Column | str) -> Column:
    """Uniform LONG in [0, n) from 32 bits: for n far below 2**32 (choices, groups, places in a document)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(seed_u32(seed, *keys), n.cast("long"))


def seed_place(n: Column | int, seed: int | str, *keys: Column | str) -> Column:
    """Uniform LONG in [0, n) from 60 bits, for ranges that grow with the data (tokens of a store)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(seed_key(seed, *keys), 1, 15), 16, 10).cast("long"), n.cast("long"))


def name_seed(name: Column) -> Column:
    """First four bytes of SHA-256, big-endian, as an unsigned integer."""
    return hex_u32(F.sha2(name, 256))
