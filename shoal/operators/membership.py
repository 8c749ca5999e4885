"""Look-ups and exports: which documents share a cluster, with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.clusters import CLUSTER, cluster_sizes, small_cluster_members
from shoal.session import BROADCAST_ROWS

MEMBER_COLUMNS = ["question_id", "title", "answer_count", "text_length", "cluster_id"]


def with_metadata(assignments: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join on the id: rows without metadata stay, with nulls."""
    return assignments.join(meta, "question_id", "left")


def in_cluster(meta: DataFrame, assignments: DataFrame, cluster_id: int) -> DataFrame:
    """Metadata rows whose id is in the cluster."""
    return meta.join(assignments.filter(F.col("cluster_id") == cluster_id), "question_id", "left_semi")


def cluster_titles(meta: DataFrame, assignments: DataFrame, cluster_id: int) -> DataFrame:
    return in_cluster(meta, assignments, cluster_id).select("question_id", "title")


def unmatched(left: DataFrame, right: DataFrame, key: str = "question_id") -> DataFrame:
    """(side, key) of ids that occur on one side only."""
    only_left = left.select(key).distinct().join(right, key, "left_anti").select(F.lit("left").alias("side"), key)
    only_right = right.select(key).distinct().join(left, key, "left_anti").select(F.lit("right").alias("side"), key)
    return only_left.unionByName(only_right)


def aligned(assignments: DataFrame, meta: DataFrame) -> DataFrame:
    """Inner join on the id, allowed only if both sides hold the same ids."""
    missing = unmatched(assignments, meta).limit(1).collect()
    if missing:
        raise ValueError(f"labels and metadata differ: id {missing[0]['question_id']} is only on one side")
    return assignments.join(meta, "question_id")


def find_question(meta: DataFrame, question_id: int) -> DataFrame:
    """The metadata row of one question; an unknown id is an error."""
    row = meta.filter(F.col("question_id") == question_id)
    if row.isEmpty():
        raise KeyError(f"question {question_id} not found")
    return row


def clusters_of(assignments: DataFrame, question_id: int) -> DataFrame:
    """(k, variant, cluster_id): one row per labeling that contains the question."""
    return assignments.filter(F.col("question_id") == question_id).select(*CLUSTER)


def cluster_of_question(assignments: DataFrame, meta: DataFrame, question_id: int) -> DataFrame:
    """All members of the question's cluster in every labeling, with metadata.

    The question's clusters are one row per labeling: a filter on the assignments, not a shuffle of them.
    """
    mine = clusters_of(assignments, question_id)
    side = F.broadcast(mine) if mine.count() <= BROADCAST_ROWS else mine
    members = assignments.join(side, CLUSTER, "left_semi")
    return with_metadata(members, meta).select("k", "variant", *MEMBER_COLUMNS)


def question_summary(assignments: DataFrame, question_id: int, ks: list[int] | None = None) -> DataFrame:
    """(k, variant, cluster_id, cluster_size) of the question's clusters, sorted."""
    chosen = assignments.filter(F.col("k").isin(ks)) if ks else assignments
    mine = clusters_of(chosen, question_id)
    side = F.broadcast(mine) if mine.count() <= BROADCAST_ROWS else mine
    return cluster_sizes(chosen.join(side, CLUSTER, "left_semi")).orderBy("k", "variant")


def small_cluster_export(assignments: DataFrame, meta: DataFrame, max_size: int = 10) -> DataFrame:
    """Members of all small clusters with metadata and cluster size, ready for a partitioned write."""
    members = with_metadata(small_cluster_members(assignments, max_size), meta)
    return members.select("k", "variant", *MEMBER_COLUMNS, "cluster_size")
