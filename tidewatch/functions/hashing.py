"""Repeatable random draws from keys.

A draw is ``md5('<seed>:<key>[<salt>]')``; it depends only on the seed and the
row key, never on partitioning or row order, and the same expression is
written in any SQL engine with md5, so results can be checked against an
oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_hex(key, seed: int = DEFAULT_SEED, salt: str | None = None) -> Column:
    parts = [F.lit(f"{seed}:"), _c(key).cast("string")]
    if salt:
        parts.append(F.lit(salt))
    return F.md5(F.concat(*parts))


def hash_int(key, seed: int = DEFAULT_SEED, salt: str | None = None,
             digits: int = 15) -> Column:
    """Non-negative integer from the first ``digits`` hex digits (<= 15)."""
    return F.conv(F.substring(hash_hex(key, seed, salt), 1, digits), 16, 10).cast("bigint")


def hash_unit(key, seed: int = DEFAULT_SEED, salt: str | None = None) -> Column:
    """Uniform draw in [0, 1) from 32 bits of the hash."""
    return hash_int(key, seed, salt, digits=8) / F.lit(4294967296.0)


def fast_hash_unit(*cols, seed: int = DEFAULT_SEED) -> Column:
    """Cheaper uniform draw (xxhash64) for hot loops that need no SQL oracle."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.abs(h % F.lit(1 << 30)).cast("double")) / F.lit(float(1 << 30))
