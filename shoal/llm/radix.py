"""Exact duplicates by most-significant-digit radix partitioning.

A digit is a run of bytes: the first 64 of a text, the next 1024, and so on, each 16 times as wide. Documents with equal
digits so far form a group. A group of one, or one whose texts have ended, is done; the others split by their next
digit. Texts are compared byte by byte; no digest decides equality.

Only the groups' counts are shuffled at first (a task adds up its own rows, so a text that a third of the rows share is
one row per task). The texts themselves are shuffled once, and then only those of groups that are still open. A hot group is a
skewed join that adaptive execution splits; no group is gathered.

Nulls: a null text is empty. Null ids sort first and can be the id that stays. Rows that repeat an id count as rows of
their own; of equal rows with equal ids one is kept. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.scratch import fresh, saved, small

FIRST_DIGIT = 64
GROWTH = 16
MAX_DIGIT = 1 << 28


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")


def _split(rows: DataFrame, width: int, carried: list[str]) -> DataFrame:
    """Split the open groups of `rows(_group, rest, ...)` by the first `width` bytes of `rest`.

    Adds to each row its group's size, its smallest id and whether it is done; `rest` loses the digit, and is null when
    it is not needed any more.
    """
    cut = rows.withColumn("_digit", F.substring("rest", 1, width)).drop("group_size", "keep_id")
    groups = cut.groupBy("_group", "_digit").agg(
        F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id"))).getField("doc_id").alias("keep_id"),
        F.min("text_sha256").alias("_name")).filter("group_size > 1")
    # Saved, so that the join reads plain shuffles on both sides and a hot group's rows can be split.
    groups = saved(groups.select(
        F.col("_group").alias("_g"), F.col("_digit").alias("_d"), "group_size", "keep_id", "_name"), "radix-groups")
    joined = cut.join(groups, (F.col("_group") == F.col("_g")) & (F.col("_digit") == F.col("_d")), "left")
    alone = F.col("group_size").isNull()
    done = alone | (F.length("_digit") < width)
    return joined.select(
        *carried, F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), done.alias("done"),
        F.coalesce("_name", F.lit("")).alias("_group"),
        F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_digit: int = FIRST_DIGIT,
                 growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of `docs`, dropped ones too.

    `text_sha256` is part of the report. It also names a group in later rounds (by the smallest in it); which rows are
    in a group is decided by their bytes alone.
    """
    plain = normalised(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(plain, 256).alias("text_sha256"), plain.cast("binary").alias("rest"),
        F.lit("").alias("_group"))
    carried, width, finished = ["doc_id", "text_sha256"], first_digit, []
    while True:
        rows = saved(_split(rows, width, carried), "radix")
        finished.append(rows.filter("done").drop("done", "rest", "_group"))
        rows = rows.filter("not done").drop("done")
        if rows.isEmpty():
            break
        width = min(width * growth, MAX_DIGIT)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    one = F.row_number().over(Window.partitionBy("doc_id", "keep_id", "text_sha256").orderBy("group_size")) == 1
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & one).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, all columns unchanged; of rows that repeat both id and text, one stays.

    Decisions meet the rows by id and by the text's digest, since ids may repeat. Dropped rows are broadcast if they are
    few, else both sides are shuffled.
    """
    groups = saved(exact_groups(docs, text, doc_id), "copies")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    name, sha = fresh(docs, "dropped"), fresh(docs, "dropped_sha256")
    dropped = groups.filter(~own).select("doc_id", "text_sha256").distinct().toDF(name, sha)
    digest = F.sha2(normalised(F.col(text)), 256)
    out = docs.join(small(dropped, 200_000), F.col(doc_id).eqNullSafe(F.col(name)) & (digest == F.col(sha)), "left_anti")
    if not groups.filter(own & ~F.col("kept")).isEmpty():
        out = out.withColumn(sha, digest).dropDuplicates([doc_id, sha]).drop(sha)
    return out
