import numpy as np
import pytest
from helpers import labels, vectors
from pyspark.sql import functions as F

from shoal.operators import ordering, sampling
from shoal.operators.nearest import nearest
from shoal.operators.reduce import fit, project
from shoal.plans import baselines, kmeans
from shoal.session import scratch_path
from shoal.sources.tables import AssignmentStore, SearchLog


def sizes(df):
    return [r.n for r in df.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy("cluster_id").collect()]


def meta(spark, lengths):
    return spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "question_id long, text_length int")


def test_buckets_with_remainder(spark):
    assert sizes(baselines.length_buckets(meta(spark, range(10)), [3])) == [3, 3, 4]


def test_fewer_rows_than_buckets(spark):
    out = baselines.length_buckets(meta(spark, [5, 6]), [3]).collect()
    assert [r.cluster_id for r in out] == [2, 2]


def test_tied_lengths_go_by_id(spark):
    out = baselines.length_buckets(meta(spark, [7] * 6), [2]).orderBy("question_id").collect()
    assert [r.cluster_id for r in out] == [0, 0, 0, 1, 1, 1]


def test_row_number_equals_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 5, 1000))]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    got = {r.id: r.rn for r in ordering.with_row_number(df, ["v", "id"], partitions=5).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_shuffle_keeps_sizes(spark):
    given = labels(spark, [0] * 5 + [1] * 3 + [4] * 2)
    out = baselines.shuffle_size(given)
    assert sizes(out) == [5, 3, 2]
    assert {r.question_id for r in out.collect()} == set(range(10))


def test_uniform_random_is_repeatable_and_in_range(spark):
    ids = spark.range(2000)
    one = baselines.uniform_random(ids, [7]).collect()
    two = baselines.uniform_random(ids.repartition(3), [7]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    counts = np.bincount([r.cluster_id for r in one], minlength=7)
    assert len(counts) == 7 and counts.min() > 200


def test_one_shot_centres_are_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    ids, centres = baselines.seed_centres(vectors(spark, x), 6)
    assert len(set(ids)) == 6
    assert np.allclose(x[ids], centres)
    again = baselines.seed_centres(vectors(spark, x).repartition(5), 6)[0]
    assert list(ids) == list(again)


def test_one_shot_with_few_distinct_rows(spark):
    ids, _ = baselines.seed_centres(vectors(spark, [(0, 0)] * 6 + [(1, 1)] * 6), 4)
    assert len(set(ids)) == 4


@pytest.mark.parametrize("limit", [1 << 28, 48])
def test_nearest_ties_go_to_the_lowest_id(spark, limit):
    centres = spark.createDataFrame([(3, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 5.0])], "cluster_id int, vec array<double>")
    out = nearest(vectors(spark, [(0, 0), (2, 0), (0, 4)]), centres, limit_bytes=limit).orderBy("id").collect()
    assert [(r.cluster_id, r.dist) for r in out] == [(1, 1.0), (3, 1.0), (2, 1.0)]


def test_sample_is_exact_and_stable(spark):
    ids = spark.range(20000)
    one = {r.id for r in sampling.sample_ids(ids, 100).collect()}
    assert len(one) == 100
    assert one == {r.id for r in sampling.sample_ids(ids.repartition(9), 100).collect()}
    assert sampling.sample(ids, 30000).count() == 20000


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = vectors(spark, x)
    parts = fit(rows, 4)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ vt[:4].T)
    got = np.array([r.vec for r in project(rows, parts).orderBy("id").collect()])
    assert np.allclose(np.abs(got), want)
    assert np.allclose(parts.shares, (s**2 / (s**2).sum())[:4])
    assert (parts.loadings[np.abs(parts.loadings).argmax(0), range(4)] > 0).all()


def test_kmeans_is_repeatable_and_labels_zero_rows(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 4)), np.zeros((2, 4))])
    runs = []
    for rows in (vectors(spark, x), vectors(spark, x).repartition(6)):
        f = kmeans.features(rows, 4)
        runs.append(sorted(map(tuple, kmeans.assign(kmeans.fit(f, 5), f, 5).collect())))
    assert runs[0] == runs[1]
    assert sorted(r[0] for r in runs[0]) == list(range(62))
    assert kmeans.zero_vectors(vectors(spark, x)).count() == 2


def test_a_search_goes_on_where_it_broke_off(spark):
    x = np.random.default_rng(5).normal(size=(80, 4))
    whole = kmeans.search(vectors(spark, x), [2, 3, 4]).search.drop("seconds").orderBy("k").collect()
    folder = scratch_path(spark, "search")
    log, store = SearchLog(spark, f"{folder}/log"), AssignmentStore(spark, f"{folder}/labels")
    kmeans.search(vectors(spark, x), [3], store=store, save_every=1, log=log)
    before = log.read().filter("k = 3").first()
    found = kmeans.search(vectors(spark, x), [2, 3, 4, 100], store=store, save_every=1, log=log)
    assert found.search.drop("seconds").orderBy("k").collect()[:3] == whole
    assert log.read().filter("k = 3").collect() == [before]
    assert sorted(r.k for r in store.labelings().collect()) == sorted(r.k for r in log.read().collect())
    assert 100 in found.failed or 100 in {r.k for r in log.read().collect()}


def test_gaussian_directions_are_unit_and_fixed_by_the_seed(spark):
    rows = baselines.gaussian_directions(spark, 7, 16, 42).orderBy("cluster_id").collect()
    assert [r.cluster_id for r in rows] == list(range(7))
    x = np.array([r.vec for r in rows])
    assert x.shape == (7, 16) and np.allclose(np.linalg.norm(x, axis=1), 1)
    assert rows == baselines.gaussian_directions(spark, 7, 16, 42).orderBy("cluster_id").collect()
    assert rows != baselines.gaussian_directions(spark, 7, 16, 43).orderBy("cluster_id").collect()


def test_running_best_is_strict(spark):
    rows = list(zip([20, 40, 60, 80, 100], [4.1, 3.9, 3.9, 3.95, 3.8]))
    out = kmeans.running_best(spark.createDataFrame(rows, "k int, dbi double")).orderBy("k").collect()
    assert [r.is_new_best for r in out] == [True, True, False, False, True]


def test_choice_follows_the_direction_of_the_metric(spark):
    rows = [("a", "dbi", 3.0), ("b", "dbi", 2.0), ("c", "silhouette", 0.1), ("d", "silhouette", 0.4)]
    df = spark.createDataFrame(rows, "name string, metric string, score double")
    assert kmeans.choose(df, "dbi").first().name == "b"
    assert kmeans.choose(df, "silhouette").first().name == "d"
