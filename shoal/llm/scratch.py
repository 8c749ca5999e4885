"""Tables between two jobs, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import sys
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.session import BROADCAST_ROWS, scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as compressed Parquet to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a second read of the file, not a second run of the job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a saved table of numbers for broadcast if its counted rows are few enough, else leave the join to shuffle.

    Either plan gives the same rows.
    """
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """`df` with `rank`, the place (from 0) of a row among those of its group in `order`, and `n`, the rows of the group.

    One range shuffle sorts the rows, so a large group is spread; counts of (partition, group) give the offsets. Groups must
    not be null. `df` is read twice (range bounds come from a sample), so it should be a saved table.
    """
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ranged = saved(ranged.withColumn("_line", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_line", 33)  # the id keeps the partition above its lower 33 bits
    runs = ranged.groupBy(part.alias("_part"), *groups).agg(F.min("_line").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*groups)
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = saved(runs.select(
        "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("n"),
        *[F.col(g).alias(f"_of_{g}") for g in groups]), "runs")
    match = part == F.col("_part")
    for g in groups:
        match = match & (F.col(g) == F.col(f"_of_{g}"))
    rank = F.col("_line") - F.col("_first") + F.col("_before")
    return ranged.join(small(runs), match).select(*df.columns, rank.alias("rank"), "n")


def without(docs: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is not in the one column of `ids`; a null id is an id like others."""
    name = fresh(docs, "dropped")
    ids = saved(ids.toDF(name).distinct(), "dropped")
    return docs.join(small(ids), F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")


def trim() -> None:
    """Give the free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if give is not None:
        give(0)


def release(spark: SparkSession) -> None:
    """Let the idle worker processes forget what they keep and give their free memory back to the system.

    A worker is used again for the next job, and the allocators hold what the last one needed. Several short tasks a core reach
    the workers; one that is missed only keeps its memory.
    """
    def run(batches):
        yield from batches
        for name in ("bpe", "simple8b", "words", "zlang"):
            module = sys.modules.get(f"shoal.llm.{name}")
            for kept in ("_workers", "_powers"):
                getattr(module, kept, {}).clear()
        gc.collect()
        trim()
        time.sleep(0.1)  # so that one worker does not take all tasks of its executor

    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").count()


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def share(column: Column) -> Column:
    """A number in [0, 1) that is fixed for a value, for samples that do not depend on partitioning."""
    return F.pmod(F.xxhash64(column), F.lit(1_000_003)) / F.lit(1_000_003.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
