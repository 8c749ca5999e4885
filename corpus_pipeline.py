"""A training corpus from raw documents: the stages below, each written as Parquet and read again by the next.

A stage works on all that its predecessor kept. All but the last return the columns of `documents`; the last returns the
token counts and digests of the documents that are left. Workers give back the memory of the stage before. Null and empty texts, null and
repeated ids and tables without rows pass through as each operator's docstring says: none is a failure, and an empty table gives an empty one. No stage has SQL: toxicity, near copies and tilings are not SQL's
to say, so the pipeline is tested against its parts and against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoal.llm import adaptjoin, bpe, radix, tiling, weak
from shoal.llm.scratch import release, saved, table


BATCH_ROWS = "1000"
# What an encoding worker keeps: less than a query by itself may, since the executors still hold what the stages before needed.
KEPT_STATES, KEPT_WORDS = 50_000, 30_000


def _ready(spark: SparkSession) -> None:
    """Stages follow each other in the same workers, so they get small batches, and give back the memory of the stage before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    release(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    _ready(spark)
    return weak.clean_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    _ready(spark)
    return radix.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles (0.8 or more) the smallest doc_id stays."""
    _ready(spark)
    return adaptjoin.distinct_documents(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    _ready(spark)
    return tiling.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    _ready(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_states=KEPT_STATES, max_words=KEPT_WORDS)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
