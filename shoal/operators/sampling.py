"""Sampling without replacement that does not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.hashing import digest, leading_bits
from shoal.session import BROADCAST_ROWS


def sample_ids(df: DataFrame, n: int, seed=42, id_col: str = "id") -> DataFrame:
    """The ids of the n rows that come first in md5 order.

    The leading bits of the digest are uniform, so a threshold a little above n / rows keeps just over n
    rows per table instead of n rows per partition for the final ordering; it is widened until n rows are in.
    """
    ids = df.select(id_col).withColumn("_digest", digest(F.col(id_col), seed))
    rows = df.count()
    share = min(1.0, (n + 6.0 * math.sqrt(n) + 20.0) / max(rows, 1))
    while share < 1.0:
        near = ids.filter(leading_bits(F.col("_digest")) < F.lit(int(share * 2**32)))
        if near.count() >= n:
            ids = near
            break
        share = min(1.0, share * 2.0)
    return ids.orderBy("_digest", id_col).limit(n).select(id_col)


def sample(df: DataFrame, n: int, seed=42, id_col: str = "id") -> DataFrame:
    """n rows (all rows if there are fewer), chosen by md5 order of the id."""
    ids = sample_ids(df, n, seed, id_col)
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, id_col, "left_semi")


def head(df: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(order_col).limit(n)
