"""Vector queries: normalising, centroids, nearest centroids, neighbours, sampling, principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.catalog.common import (
    KS, SEED, SQL_ASSIGNMENTS, SQL_GIVEN, SQL_VECTORS, assignments, given_labels, vectors,
)
from shoal.functions.vectors import cosine, euclidean, l2_norm
from shoal.operators.centroids import centroids, with_labels
from shoal.operators.nearest import nearest
from shoal.operators.proximity import k_distance, k_distance_curve, neighbour_counts
from shoal.operators.reduce import fit, kept_variance, project, project_2d, reduce_to
from shoal.operators.sampling import sample_ids
from shoal.session import BROADCAST_BYTES, checkpoint

EPS_EUCLIDEAN = 1.15
EPS_COSINE = 0.6
SIZES = [8, 16, 32]


def unit_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode("vec").alias("j", "x")).select(
        "id", (F.col("j") + 1).cast("long").alias("j"), F.round("x", 6).alias("x"))


def _centroids(spark, sf_dir, labels):
    labelled = with_labels(vectors(spark, sf_dir), labels)
    return labelled.labeling_table().join(centroids(labelled), "lab").drop("lab")


def cluster_centroids(spark, sf_dir):
    means = _centroids(spark, sf_dir, assignments(spark, sf_dir))
    return means.select("k", "variant", "cluster_id", "n", F.posexplode("vec").alias("j", "x")).select(
        "k", "variant", "cluster_id", "n", (F.col("j") + 1).cast("long").alias("j"), F.round("x", 6).alias("x"))


def own_centroid_distances(spark, sf_dir):
    means = _centroids(spark, sf_dir, given_labels(spark, sf_dir)).select("cluster_id", F.col("vec").alias("mean"))
    means = checkpoint(means)
    size = means.agg(F.count("*"), F.max(F.size("mean"))).first()
    if size[0] * (size[1] or 0) * 8 <= BROADCAST_BYTES:  # a cluster with a third of the rows is no hot key then
        means = F.broadcast(means)
    rows = vectors(spark, sf_dir).join(
        given_labels(spark, sf_dir).select(F.col("question_id").alias("id"), "cluster_id"), "id").join(means, "cluster_id")
    return rows.select("id", F.round(euclidean(F.col("vec"), F.col("mean")), 6).alias("euclidean"),
                       F.round(cosine(F.col("vec"), F.col("mean")), 6).alias("cosine"))


def nearest_centroid(spark, sf_dir):
    means = _centroids(spark, sf_dir, given_labels(spark, sf_dir)).select("cluster_id", "vec")
    return nearest(vectors(spark, sf_dir), means).withColumn("dist", F.round("dist", 6))


def k_distance_euclidean(spark, sf_dir):
    return k_distance(vectors(spark, sf_dir), 5, "euclidean").withColumn("k_dist", F.round("k_dist", 6))


def k_distance_cosine(spark, sf_dir):
    return k_distance(vectors(spark, sf_dir), 5, "cosine").withColumn("k_dist", F.round("k_dist", 6))


def k_distance_curve_euclidean(spark, sf_dir):
    return k_distance_curve(vectors(spark, sf_dir), 5, "euclidean")


def neighbours_within_eps(spark, sf_dir):
    return neighbour_counts(vectors(spark, sf_dir), EPS_EUCLIDEAN, "euclidean")


def neighbours_within_cosine(spark, sf_dir):
    return neighbour_counts(vectors(spark, sf_dir), EPS_COSINE, "cosine")


def sampled_ids(spark, sf_dir):
    return sample_ids(vectors(spark, sf_dir), 200, SEED)


def total_variance(spark, sf_dir):
    """Variance per table and per full set of components; a rotation keeps it."""
    rows = vectors(spark, sf_dir)
    dims = rows.agg(F.max(F.size("vec"))).first()[0]
    full = project(rows, fit(rows, dims)).select(F.posexplode("vec").alias("j", "x"))
    return full.groupBy("j").agg(F.var_pop("x").alias("v")).agg(F.round(F.sum("v"), 6).alias("variance"))


def reduced_vectors(spark, sf_dir):
    out = None
    for size, rows in reduce_to(vectors(spark, sf_dir), SIZES).items():
        part = rows.select(F.lit(size).alias("size"), "id", F.round(l2_norm(F.col("vec")), 6).alias("norm"))
        out = part if out is None else out.unionByName(part)
    return out


def kept_variance_shares(spark, sf_dir):
    shares = kept_variance(fit(vectors(spark, sf_dir), max(SIZES)), SIZES)
    return spark.createDataFrame(shares, "size int, share double").withColumn("share", F.round("share", 6))


def plane_projection(spark, sf_dir):
    return project_2d(vectors(spark, sf_dir), given_labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    unit_vectors, cluster_centroids, own_centroid_distances, nearest_centroid, k_distance_euclidean, k_distance_cosine,
    k_distance_curve_euclidean, neighbours_within_eps, neighbours_within_cosine, sampled_ids, total_variance, reduced_vectors, kept_variance_shares,
    plane_projection,
)}

_SQL_MEANS = """means AS (SELECT cluster_id, list(x ORDER BY j) AS mean FROM (
  SELECT label AS cluster_id, j, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY cluster_id)"""
_SQL_COS = "list_cosine_similarity(a.vec, b.vec)"

SQL = {
    "unit_vectors": f"WITH {SQL_VECTORS} SELECT id, j, round(x, 6) AS x FROM dims",
    "cluster_centroids": f"""WITH {SQL_VECTORS}, {SQL_ASSIGNMENTS}
      SELECT k, variant, cluster_id, count(*) AS n, j, round(avg(x), 6) AS x
      FROM assignments JOIN dims ON id = question_id GROUP BY k, variant, cluster_id, j""",
    "own_centroid_distances": f"""WITH {SQL_VECTORS}, {_SQL_MEANS}
      SELECT id, round(list_distance(vec, mean), 6) AS euclidean, round(list_cosine_similarity(vec, mean), 6) AS cosine
      FROM vectors JOIN means ON cluster_id = label""",
    "nearest_centroid": f"""WITH {SQL_VECTORS}, {_SQL_MEANS},
      d AS (SELECT id, cluster_id, list_distance(vec, mean) AS dist FROM vectors, means)
      SELECT id, arg_min(cluster_id, dist) AS cluster_id, round(min(dist), 6) AS dist FROM d GROUP BY id""",
    "k_distance_euclidean": f"""WITH {SQL_VECTORS},
      d AS (SELECT a.id, list_distance(a.vec, b.vec) AS dist FROM vectors a, vectors b),
      r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rn FROM d)
      SELECT id, round(dist, 6) AS k_dist FROM r WHERE rn = 5""",
    "k_distance_cosine": f"""WITH {SQL_VECTORS}, d AS (SELECT a.id, 1 - {_SQL_COS} AS dist FROM vectors a, vectors b),
      r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rn FROM d)
      SELECT id, round(dist, 6) AS k_dist FROM r WHERE rn = 5""",
    "k_distance_curve_euclidean": f"""WITH {SQL_VECTORS},
      d AS (SELECT a.id, list_distance(a.vec, b.vec) AS dist FROM vectors a, vectors b),
      r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rn FROM d),
      k AS (SELECT id, round(dist, 6) AS k_dist FROM r WHERE rn = 5)
      SELECT row_number() OVER (ORDER BY k_dist, id) AS rank, id, k_dist FROM k""",
    "neighbours_within_eps": f"""WITH {SQL_VECTORS}
      SELECT a.id, count(*) AS neighbours FROM vectors a, vectors b
      WHERE list_distance(a.vec, b.vec) <= {EPS_EUCLIDEAN} GROUP BY a.id""",
    "neighbours_within_cosine": f"""WITH {SQL_VECTORS}
      SELECT a.id, count(*) AS neighbours FROM vectors a, vectors b WHERE 1 - {_SQL_COS} <= {EPS_COSINE} GROUP BY a.id""",
    "sampled_ids": f"SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id || ':{SEED}'), vec_id LIMIT 200",
    "total_variance": f"""WITH {SQL_VECTORS}, v AS (SELECT j, var_pop(x) AS v FROM dims GROUP BY j)
      SELECT round(sum(v), 6) AS variance FROM v""",
}
