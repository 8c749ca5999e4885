"""Whole-file JSON arrays of objects, read in parallel.

A file is read as segments that end with a closing brace, which Spark's text source can split at any byte. Whether a segment begins
inside a string, and how deep it is nested, follows from running counts of quotes and braces: sums per block of the file first, then a running sum inside a
block. Segments of one object get its number and are put together again; an object may span blocks, a file may span any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.session import scratch_path


def _running(df: DataFrame, column: str, name: str) -> DataFrame:
    """`name`: the sum of `column` over all earlier segments of the file."""
    blocks = df.groupBy("file", "block").agg(F.sum(column).alias("_sum"))  # a row to a block
    before = F.sum("_sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(column).over(Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(F.broadcast(blocks), ["file", "block"]).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_before")


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the objects of the JSON arrays at `path`, numbered from 0 in each file, in order.

    What is not an object at the top level (numbers, strings, nested arrays) is not read. A file whose last object does not end gives an
    object that cannot be parsed.
    """
    segments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", F.regexp_replace("value", r"\\.", "").alias("plain"))
    # Without escaped characters each quote begins or ends a string, and the pieces between quotes lie inside and outside of strings in turn.
    pieces = F.split("plain", '"')
    braces = [_count(F.array_join(F.filter(pieces, turn), ""), "{").alias(name)
              for name, turn in (("even", lambda x, i: i % 2 == 0), ("odd", lambda x, i: i % 2 == 1))]
    kept = scratch_path(spark, "segments")
    segments.select("file", "block", "line", "value", (F.size(pieces) - 1).alias("quotes"), *braces).write.parquet(kept)
    lines = _running(spark.read.parquet(kept), "quotes", "quotes_before")
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the closing brace is no part of a string
    opened = F.when(F.col("quotes_before") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    lines = lines.withColumn("opened", opened).withColumn("change", F.col("opened") - F.when(closes, 1).otherwise(0))
    lines = _running(lines, "change", "depth")
    ends = closes & (F.col("depth") + F.col("change") == 0)
    lines = _running(lines.withColumn("ended", F.when(ends, 1).otherwise(0)), "ended", "number")
    # An object's first segment begins with what stands before it; the rest after the last object holds no brace.
    start = F.when(F.col("depth") == 0, F.regexp_replace("value", r"^[^{]*", "")).otherwise(F.col("value"))
    parts = lines.filter((F.col("depth") > 0) | (F.col("opened") > 0))
    segment = F.struct("block", "line", start.alias("value"))
    return parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(segment)).alias("segments")).select(
        "file", "number", F.concat(F.array_join(F.col("segments.value"), "}"), F.lit("}")).alias("text"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the JSON arrays at `path` as rows of `schema`; an object that cannot be parsed gives a row of nulls."""
    return read_objects(spark, path).select(F.from_json("text", schema).alias("row")).select("row.*")
