"""Distances between all rows of a group, as sums and maxima per tile pair: pairs themselves are never emitted.

The rows of a group are hashed into tiles of about `tile_rows` rows, and every pair of tiles is one unit of work
(one matrix product), so neither memory nor the longest task depends on the size of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import block, squared_distances, values
from shoal.session import BROADCAST_ROWS

TILE_ROWS = 4096
STRIP_ROWS = 256


def tile_pairs(df: DataFrame, group_cols: list[str], id_cols: list[str], tile_rows: int = TILE_ROWS,
               sizes: DataFrame | None = None) -> DataFrame:
    """Send every row to each unordered pair (`ta` <= `tb`) of its group's tiles that contains its own tile.

    `sizes(group_cols..., n)` saves counting the groups again. Only groups of more than one tile are looked up.
    """
    if sizes is None:
        sizes = df.groupBy(*group_cols).agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > tile_rows).select(
        *group_cols, F.ceil(F.col("n") / tile_rows).cast("int").alias("_tiles"))
    n_large = large.count()
    if n_large == 0:
        zero = F.lit(0)
        return df.select("*", zero.alias("tile"), zero.alias("ta"), zero.alias("tb"))
    side = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    tiled = df.join(side, group_cols, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64(*id_cols), F.col("_tiles")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    return (
        tiled.withColumn("_u", partner)
        .withColumn("ta", F.least("tile", "_u"))
        .withColumn("tb", F.greatest("tile", "_u"))
        .drop("_u", "_tiles")
    )


def split_tiles(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row positions of the two tiles of a pair, and whether they are the same tile."""
    tile = values(table.column("tile"))
    ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    return np.flatnonzero(tile == ta), np.flatnonzero(tile == tb), ta == tb


def within_group_distances(df: DataFrame, group_cols: list[str], tile_rows: int = TILE_ROWS,
                           sizes: DataFrame | None = None) -> DataFrame:
    """(group, pair_sum, pair_max): over all ordered pairs of a group's rows, the self pairs included.

    `df(group_cols..., id, vec)`. The number of pairs is the squared group size, which the caller already has.
    """
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in group_cols)

    def partial(table: pa.Table) -> pa.Table:
        a, b, same = split_tiles(table)
        x = block(table.column("vec"))
        left, right = x[a], x[b]
        total, largest = 0.0, 0.0
        for start in range(0, len(left), STRIP_ROWS):
            d2 = squared_distances(left[start:start + STRIP_ROWS], right)
            if same:
                at = np.arange(d2.shape[0])
                d2[at, start + at] = 0.0
            d = np.sqrt(d2, out=d2)
            if d.size:
                total += float(d.sum())
                largest = max(largest, float(d.max()))
        keys = {c: table.column(c).slice(0, 1) for c in group_cols}
        return pa.table({**keys, "pair_sum": [total if same else 2.0 * total], "pair_max": [largest]})

    tiles = tile_pairs(df.select(*group_cols, "id", "vec"), group_cols, ["id"], tile_rows, sizes)
    partials = tiles.groupBy(*group_cols, "ta", "tb").applyInArrow(partial, f"{fields}, pair_sum double, pair_max double")
    return partials.groupBy(*group_cols).agg(F.sum("pair_sum").alias("pair_sum"), F.max("pair_max").alias("pair_max"))
