"""K-means on keyed vectors, and the search over a grid of K."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.centroids import Labelled
from shoal.operators.nearest import nearest_all
from shoal.plans.baselines import all_seeds
from shoal.plans.lloyd import Fit, JointFit, groups_of, joint_fit
from shoal.plans.metrics import HIGHER_IS_BETTER, Evaluation

SEED = 42
START_SCORE = 999.0
PARTITION_BYTES = 64 * 1024 * 1024
SMALL_PARTITION_BYTES = 2 * 1024 * 1024
SEARCH_SCHEMA = "k int, dbi double, inertia double, seconds double"


def zero_vectors(vectors: DataFrame) -> DataFrame:
    """Ids of rows without any direction (empty texts), to report; fits label them like any other row."""
    return vectors.filter(~F.exists("vec", lambda x: x != 0)).select("id")


def partitions_for(size: int) -> int:
    """Up to 64 small partitions for small tables, then one per PARTITION_BYTES."""
    return max(1, min(64, math.ceil(size / SMALL_PARTITION_BYTES)), math.ceil(size / PARTITION_BYTES))


def features(vectors: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, vec, features) of every row, in partitions that depend only on the data.

    MLlib draws its starting centres per partition, so placement and order of the rows are pinned by id.
    """
    if partitions is None:
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
        partitions = partitions_for(size["n"] * (size["d"] or 0) * 8)
    pinned = vectors.repartition(partitions, "id").sortWithinPartitions("id")
    return pinned.select("id", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))


def fit(feature_rows: DataFrame, k: int, seed: int = SEED, max_iter: int = 20) -> KMeansModel:
    """Embeddings are dense, so the solver that works on blocks of rows is named instead of left to be guessed."""
    return KMeans(k=k, seed=seed, maxIter=max_iter, solver="block", featuresCol="features",
                  predictionCol="cluster_id").fit(feature_rows)


def assign(model: KMeansModel, feature_rows: DataFrame, k: int) -> DataFrame:
    """(question_id, k, variant, cluster_id)"""
    return model.transform(feature_rows).select(
        F.col("id").alias("question_id"), F.lit(k).alias("k"), F.lit("kmeans").alias("variant"), "cluster_id"
    )


def evaluation_of(model: KMeansModel, feature_rows: DataFrame, k: int) -> Evaluation:
    """Evaluation of a fitted labeling; label and vector are in one row, so nothing is joined."""
    label = F.array(F.struct(F.lit(0).alias("lab"), F.col("cluster_id").cast("int").alias("cluster_id")))
    rows = model.transform(feature_rows).select("id", F.col("vec").cast("array<double>").alias("vec"), label.alias("labs"))
    return Evaluation.of(Labelled(rows, [(k, "kmeans")]))


def inertia(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(k, variant, inertia): squared distances of the rows to their cluster means."""
    ev = Evaluation(vectors, assignments)
    return ev.named(ev.stats.groupBy("lab").agg(F.sum("sum_sq").alias("inertia")))


@dataclass
class Search:
    """`failed` holds the reason for each K that cannot be fitted; `best_fit` is None if an earlier run fitted the best K."""

    search: DataFrame
    best_k: int | None
    best_fit: Fit | None
    failed: dict[int, str]


def distinct_rows(vectors: DataFrame) -> int:
    """Rows without exact copies, by a 128-bit hash."""
    return vectors.select(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit("b"), "vec").alias("b")).distinct().count()


def search(vectors: DataFrame, ks: list[int], seed: int = SEED, store=None, save_every: int = 100, log=None) -> Search:
    """Fit every K, score it by DBI on the executors, keep the lowest.

    All K are seeded in one set of rounds and fitted by one scan for each Lloyd step (`lloyd.joint_fit`), in groups whose centres fit a
    broadcast; a K gives the same result whichever others are asked for. With a `store` the labels of every K divisible by
    `save_every` are written as its (k, kmeans) partition. With a `log` each K is appended to it once its group is done, and a K that is in
    it already is not fitted again, so a search that broke off goes on where it was. A K with more centres than there are distinct
    rows, or without a DBI, is reported in `failed`; any other error stops the search. `seconds` is a group's time, shared out evenly.
    """
    spark = vectors.sparkSession
    rows = [] if log is None else [tuple(r) for r in log.read_if_any().select("k", "dbi", "inertia", "seconds").collect()]
    rows = [r for r in rows if r[0] in set(ks)]
    best = min(((r[1], r[0]) for r in rows if r[1] < START_SCORE), default=(START_SCORE, None))
    todo, failed, best_fit = sorted(set(ks) - {r[0] for r in rows}), {}, None
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if todo:
        distinct = distinct_rows(vectors)
        failed = {k: f"{k} centres, but {distinct} distinct rows" for k in todo if k > distinct}
        todo = [k for k in todo if k not in failed]
        vectors = vectors.repartition(partitions_for(size["n"] * (size["d"] or 0) * 8), "id")
    for group in groups_of(todo, size["d"] or 0) if todo else []:
        start = time.perf_counter()
        joint = joint_fit(vectors, {k: centres for k, (_, centres) in all_seeds(vectors, group, seed).items()})
        scores = scores_of(joint)
        seconds = (time.perf_counter() - start) / len(group)
        failed |= {k: "no DBI: it needs 2 <= number of clusters <= rows - 1" for k in group if k not in scores}
        kept = [k for k in group if k in scores and k % save_every == 0]
        if store is not None and kept:
            store.write(joint.assignments(kept))  # before the log, which says that a K is done
        new = [(k, scores[k], joint.fits[k].cost, seconds) for k in group if k in scores]
        if log is not None and new:
            earlier = lambda k: min((r[1] for r in rows + new if r[0] < k), default=START_SCORE)
            log.append(spark.createDataFrame(
                [(*row, row[1] < min(earlier(row[0]), START_SCORE)) for row in new], f"{SEARCH_SCHEMA}, is_new_best boolean"))
        rows += new
        for row in new:
            if row[1] < best[0]:
                best, best_fit = (row[1], row[0]), joint.fits[row[0]]
        joint.discard()
    return Search(running_best(spark.createDataFrame(sorted(rows), SEARCH_SCHEMA)), best[1], best_fit, failed)


def scores_of(joint: JointFit) -> dict[int, float]:
    """DBI of every K of a joint fit that has one; labels and vectors are in one row, so nothing is joined."""
    labels = [F.struct(F.lit(i).alias("lab"), F.col("labels")[i].alias("cluster_id")) for i in range(len(joint.ks))]
    evaluation = Evaluation.of(Labelled(joint.rows.select("id", "vec", F.array(*labels).alias("labs")), [(k, "kmeans") for k in joint.ks]))
    defined = {lab for lab, (clusters, rows, _) in evaluation.sizes.items() if 2 <= clusters <= rows - 1}
    return {joint.ks[r["lab"]]: r["dbi"] for r in evaluation.between().select("lab", "dbi").collect() if r["lab"] in defined}


def final_labels(vectors: DataFrame, found: Search) -> DataFrame:
    """(question_id, k, variant, cluster_id): every row with its nearest centre of the best fit."""
    if found.best_fit is None:
        raise ValueError("this search did not fit the best K itself; its labels are in the store")
    near = nearest_all(vectors, {found.best_k: found.best_fit.centres})
    return near.select(F.col("id").alias("question_id"), "k", F.lit("kmeans").alias("variant"), "cluster_id")


def running_best(search_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Flag the rows whose DBI is strictly below all earlier ones, in order of K. One row per fit."""
    window = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.min("dbi").over(window), F.lit(START_SCORE))
    return search_rows.withColumn("is_new_best", F.col("dbi") < F.least(before, F.lit(START_SCORE)))


def best_by_dbi(search_rows: DataFrame) -> DataFrame:
    """(best_k, best_dbi); the smaller K wins a tie."""
    low = F.min(F.struct("dbi", "k")).alias("m")
    return search_rows.agg(low).select(F.col("m.k").alias("best_k"), F.col("m.dbi").alias("best_dbi"))


def choose(candidates: DataFrame, metric: str) -> DataFrame:
    """The best of `candidates(name, metric, score)` within one metric, by that metric's direction."""
    score = F.col("score")
    order = score.desc() if HIGHER_IS_BETTER[metric] else score.asc()
    return candidates.filter(F.col("metric") == metric).orderBy(order, "name").limit(1)
