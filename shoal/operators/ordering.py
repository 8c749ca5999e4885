"""Global row numbers and equal-count buckets without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.session import checkpoint

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index of a partition in the lower 33 bits


def with_row_number(df: DataFrame, order_cols: list, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the total order of `order_cols` (which must end in a unique column).

    One range shuffle sorts the rows; the sorted table is checkpointed because range bounds come from a sample
    and must not be drawn twice. Offsets per partition (one row per partition) are then added to local indexes.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols)
    ranged = checkpoint(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _ROW_BITS).cast("int")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    offset_df = spark.createDataFrame(offsets, "_part int, _offset long")
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offset_df), "_part")
        .withColumn(name, local + F.col("_offset") + F.lit(1))
        .drop("_mid", "_part", "_offset")
    )


def bucket_of(row_number: Column, rows: int, k: int) -> Column:
    """Bucket of a 1-based position: chunks of rows // k, the last bucket takes the remainder.

    With fewer rows than buckets the chunk is empty and every row falls into the last bucket.
    """
    chunk = rows // k
    if chunk == 0:
        return F.lit(k - 1).cast("int")
    return F.least(F.floor((row_number - F.lit(1)) / F.lit(chunk)), F.lit(k - 1)).cast("int")


def equal_count_buckets(df: DataFrame, order_cols: list, ks: list[int], id_col: str = "id") -> DataFrame:
    """(question_id, k, cluster_id) for every k from one global ordering."""
    key_cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    narrow = df.select(F.col(id_col).alias("question_id"), *[c.alias(f"_o{i}") for i, c in enumerate(key_cols)])
    numbered = with_row_number(narrow, [f"_o{i}" for i in range(len(key_cols))] + ["question_id"])
    rows = numbered.count()
    labels = F.array(*[
        F.struct(F.lit(k).alias("k"), bucket_of(F.col("rn"), rows, k).alias("cluster_id")) for k in ks
    ])
    return numbered.select("question_id", F.inline(labels))


def with_row_id(df: DataFrame, order_cols: list, name: str = "id") -> DataFrame:
    """0-based row ids for tables that come without a key."""
    return with_row_number(df, order_cols, "_rn").withColumn(name, F.col("_rn") - 1).drop("_rn")
