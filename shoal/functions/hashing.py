"""Random choices as pure functions of (row id, seed): repeatable under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column, seed) -> Column:
    """md5 of `key:seed` as a hex string; its order is a random permutation of the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def leading_bits(hex_digest: Column) -> Column:
    """The first 32 bits of a digest as a non-negative long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed) -> Column:
    """A number in [0, 1) from the first 32 bits."""
    return leading_bits(digest(key, seed)) / F.lit(4294967296.0)
