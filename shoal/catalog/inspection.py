"""Cluster inspection queries over `assignments` and document metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.catalog.common import (
    SEED, SQL_ASSIGNMENTS, SQL_META, assignments, meta, sql_bits, table,
)
from shoal.operators import clusters, membership
from shoal.plans import baselines
from shoal.session import scratch_path
from shoal.sources.tables import AssignmentStore, write_csv

QUESTION = 42
FINE_KS = [100, 150]


def _fine(spark, sf_dir):
    """Uniform random labels with many clusters per row count, so that some are small."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return baselines.uniform_random(ids, FINE_KS, SEED)


def _meta(spark, sf_dir):
    """Metadata of the documents that have an embedding."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"))
    return meta(spark, sf_dir).join(ids, "question_id", "left_semi")


def labels_with_metadata(spark, sf_dir):
    return membership.with_metadata(assignments(spark, sf_dir), meta(spark, sf_dir))


def metadata_of_cluster(spark, sf_dir):
    given = assignments(spark, sf_dir).filter(F.col("variant") == "kmeans")
    return membership.in_cluster(meta(spark, sf_dir), given, 3)


def titles_of_cluster(spark, sf_dir):
    given = assignments(spark, sf_dir).filter(F.col("variant") == "kmeans")
    return membership.cluster_titles(meta(spark, sf_dir), given, 3)


def aligned_labels(spark, sf_dir):
    return membership.aligned(assignments(spark, sf_dir), _meta(spark, sf_dir))


def unmatched_ids(spark, sf_dir):
    return membership.unmatched(assignments(spark, sf_dir), meta(spark, sf_dir))


def one_cluster(spark, sf_dir):
    return clusters.of_cluster(assignments(spark, sf_dir), 3)


def noise_summary(spark, sf_dir):
    noisy = F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id"))
    return clusters.noise_summary(assignments(spark, sf_dir).withColumn("cluster_id", noisy))


def cluster_sizes(spark, sf_dir):
    return clusters.cluster_sizes(assignments(spark, sf_dir))


def size_histogram(spark, sf_dir):
    return clusters.size_histogram(_fine(spark, sf_dir))


def size_extremes(spark, sf_dir):
    return clusters.size_extremes(_fine(spark, sf_dir))


def small_clusters(spark, sf_dir):
    return clusters.small_clusters(_fine(spark, sf_dir))


def small_cluster_members(spark, sf_dir):
    return membership.small_cluster_export(_fine(spark, sf_dir), meta(spark, sf_dir))


def small_cluster_totals(spark, sf_dir):
    return clusters.small_cluster_totals(clusters.small_clusters(_fine(spark, sf_dir)))


def small_cluster_files(spark, sf_dir):
    """The export written per (k, variant) and counted from the files."""
    path = scratch_path(spark, "small-clusters")
    write_csv(membership.small_cluster_export(_fine(spark, sf_dir), meta(spark, sf_dir)), path, ["k", "variant"])
    written = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(
        "question_id long, title string, answer_count int, text_length int, cluster_id int, cluster_size long, "
        "k int, variant string").csv(path)
    return written.select("k", "variant", "cluster_id", "question_id", "title", "cluster_size")


def stored_assignments(spark, sf_dir):
    """Two labelings read back from the partitioned table."""
    store = AssignmentStore(spark, scratch_path(spark, "assignments"))
    store.write(assignments(spark, sf_dir))
    return store.read(10, "baseline_uniform_random").unionByName(store.read(20, "baseline_length_buckets"))


def question(spark, sf_dir):
    return membership.find_question(meta(spark, sf_dir), QUESTION)


def cluster_of_question(spark, sf_dir):
    return membership.cluster_of_question(assignments(spark, sf_dir), meta(spark, sf_dir), QUESTION)


def question_summary(spark, sf_dir):
    return membership.question_summary(assignments(spark, sf_dir), QUESTION, [10, 20])


QUERIES = {f.__name__: f for f in (
    labels_with_metadata, metadata_of_cluster, titles_of_cluster, aligned_labels, unmatched_ids, one_cluster,
    noise_summary, cluster_sizes, size_histogram, size_extremes, small_clusters, small_cluster_members,
    small_cluster_totals, small_cluster_files, stored_assignments, question, cluster_of_question, question_summary,
)}

_FINE = f"""fine AS (SELECT vec_id AS question_id, k, 'baseline_uniform_random' AS variant,
    CAST({sql_bits(f"md5(vec_id || ':{SEED}:' || k)")} % k AS INT) AS cluster_id
  FROM embeddings, (VALUES {", ".join(f"({k})" for k in FINE_KS)}) AS g(k)),
fine_sizes AS (SELECT k, variant, cluster_id, count(*) AS cluster_size FROM fine GROUP BY ALL),
small AS (SELECT * FROM fine_sizes WHERE cluster_size <= 10)"""
_MINE = f"mine AS (SELECT k, variant, cluster_id FROM assignments WHERE question_id = {QUESTION})"

SQL = {
    "labels_with_metadata": f"WITH {SQL_ASSIGNMENTS}, {SQL_META} SELECT * FROM assignments LEFT JOIN meta USING (question_id)",
    "metadata_of_cluster": f"""WITH {SQL_META} SELECT * FROM meta
      WHERE question_id IN (SELECT vec_id FROM embeddings WHERE label = 3)""",
    "titles_of_cluster": f"""WITH {SQL_META} SELECT question_id, title FROM meta
      WHERE question_id IN (SELECT vec_id FROM embeddings WHERE label = 3)""",
    "aligned_labels": f"WITH {SQL_ASSIGNMENTS}, {SQL_META} SELECT * FROM assignments JOIN meta USING (question_id)",
    "unmatched_ids": """SELECT 'left' AS side, vec_id AS question_id FROM embeddings
        WHERE vec_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'right', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "one_cluster": f"WITH {SQL_ASSIGNMENTS} SELECT * FROM assignments WHERE cluster_id = 3",
    "noise_summary": f"""WITH {SQL_ASSIGNMENTS}, n AS (
        SELECT k, variant, CASE WHEN cluster_id = 0 THEN -1 ELSE cluster_id END AS c FROM assignments)
      SELECT k, variant, count(*) AS rows, count(*) FILTER (c = -1) AS noise, count(*) FILTER (c <> -1) AS clustered,
        count(DISTINCT c) FILTER (c <> -1) AS clusters FROM n GROUP BY ALL""",
    "cluster_sizes": f"WITH {SQL_ASSIGNMENTS} SELECT k, variant, cluster_id, count(*) AS cluster_size FROM assignments GROUP BY ALL",
    "size_histogram": f"WITH {_FINE} SELECT * FROM fine_sizes",
    "size_extremes": f"""WITH {_FINE}, e AS (SELECT *, max(cluster_size) OVER w AS hi, min(cluster_size) OVER w AS lo
        FROM fine_sizes WHERE cluster_id <= 1000 WINDOW w AS (PARTITION BY k, variant))
      SELECT k, variant, 'max' AS extreme, cluster_size, cluster_id FROM e WHERE cluster_size = hi
      UNION ALL SELECT k, variant, 'min', cluster_size, cluster_id FROM e WHERE cluster_size = lo""",
    "small_clusters": f"WITH {_FINE} SELECT * FROM small",
    "small_cluster_members": f"""WITH {_FINE}, {SQL_META}
      SELECT k, variant, question_id, title, answer_count, text_length, cluster_id, cluster_size
      FROM fine JOIN small USING (k, variant, cluster_id) LEFT JOIN meta USING (question_id)""",
    "small_cluster_totals": f"""WITH {_FINE} SELECT k, variant, count(*) AS small_clusters,
      CAST(coalesce(sum(cluster_size), 0) AS BIGINT) AS rows FROM small GROUP BY GROUPING SETS ((k, variant), ())""",
    "small_cluster_files": f"""WITH {_FINE}, {SQL_META} SELECT k, variant, cluster_id, question_id, title, cluster_size
      FROM fine JOIN small USING (k, variant, cluster_id) LEFT JOIN meta USING (question_id)""",
    "stored_assignments": f"""WITH {SQL_ASSIGNMENTS} SELECT * FROM assignments
      WHERE (k = 10 AND variant = 'baseline_uniform_random') OR (k = 20 AND variant = 'baseline_length_buckets')""",
    "question": f"WITH {SQL_META} SELECT * FROM meta WHERE question_id = {QUESTION}",
    "cluster_of_question": f"""WITH {SQL_ASSIGNMENTS}, {SQL_META}, {_MINE}
      SELECT k, variant, question_id, title, answer_count, text_length, cluster_id
      FROM assignments JOIN mine USING (k, variant, cluster_id) LEFT JOIN meta USING (question_id)""",
    "question_summary": f"""WITH {SQL_ASSIGNMENTS}, {_MINE}
      SELECT k, variant, cluster_id, count(*) AS cluster_size FROM assignments JOIN mine USING (k, variant, cluster_id)
      WHERE k IN (10, 20) GROUP BY ALL""",
}
