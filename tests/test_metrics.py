import math

import numpy as np
import pytest
from helpers import labels, vectors

from shoal.plans import report
from shoal.plans.metrics import Evaluation, evaluate

PAIRS = [(0, 0), (0, 2), (10, 0), (10, 2)]


def table(spark, points, clusters, **kw):
    return Evaluation(vectors(spark, points), labels(spark, clusters), **kw).table().first()


@pytest.mark.parametrize("kw", [{}, {"tile_rows": 1}, {"limit_bytes": 8}])
def test_two_tight_pairs(spark, kw):
    m = table(spark, PAIRS, [0, 0, 1, 1], **kw)
    assert (m.dbi, m.chi, m.dunn, m.cohesion, m.separation) == pytest.approx((0.2, 50, 5, 1, 10))
    assert m.silhouette == pytest.approx(0.801961, abs=1e-6)
    assert m.singleton_ratio == 0


def test_singleton_cluster(spark):
    m = table(spark, PAIRS + [(100, 0)], [0, 0, 1, 1, 2])
    assert m.dbi == pytest.approx(0.137037, abs=1e-6)
    assert m.chi == pytest.approx(1830.2)
    assert m.separation == pytest.approx(66.670185, abs=1e-6)
    assert (m.dunn, m.cohesion, m.singleton_ratio) == pytest.approx((5, 1, 1 / 3))


def test_all_singletons(spark):
    ev = Evaluation(vectors(spark, PAIRS), labels(spark, [0, 1, 2, 3]))
    for rejected in (ev.dbi, ev.chi, ev.silhouette):
        with pytest.raises(ValueError):
            rejected()
    pair = ev.pair_metrics().first()
    assert math.isnan(pair.dunn) and math.isnan(pair.cohesion)


def test_one_cluster(spark):
    ev = Evaluation(vectors(spark, PAIRS), labels(spark, [5, 5, 5, 5]))
    with pytest.raises(ValueError):
        ev.dbi()
    assert math.isnan(ev.separation().first().separation)
    assert math.isnan(ev.cosine_inter().first().cosine_inter)


def test_coincident_centroids_are_ignored(spark):
    # clusters 0 and 1 share the mean (0, 0); only cluster 2 is at a distance from them
    points = [(1, 0), (-1, 0), (0, 1), (0, -1), (10, 0), (10, 2)]
    m = Evaluation(vectors(spark, points), labels(spark, [0, 0, 1, 1, 2, 2])).dbi().first()
    ratio = 2 / math.sqrt(101)
    assert m.dbi == pytest.approx(ratio)


def brute(x, c):
    ids = np.unique(c)
    mean = np.array([x[c == i].mean(0) for i in ids])
    d = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    spread = np.array([d(x[c == i], mean[[j]]).mean() for j, i in enumerate(ids)])
    between = d(mean, mean)
    off = ~np.eye(len(ids), dtype=bool)
    dbi = np.mean([max((spread[i] + spread[j]) / between[i, j] for j in range(len(ids)) if j != i) for i in range(len(ids))])
    inside = [d(x[c == i], x[c == i]) for i in ids]
    cohesion = sum(m.sum() for m in inside) / sum(m.size for m in inside)
    dunn = between[off].min() / max(m.max() for m in inside)
    return dbi, cohesion, dunn, between[off].mean()


def test_random_points_against_brute_force_in_any_tiling(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(90, 5)), rng.integers(0, 4, 90)
    for tile_rows in (4096, 7):
        m = table(spark, x, c, tile_rows=tile_rows)
        assert (m.dbi, m.cohesion, m.dunn, m.separation) == pytest.approx(brute(x, c))


def test_metrics_do_not_depend_on_cluster_names_or_partitions(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    one = evaluate(vectors(spark, x), labels(spark, c)).first()
    other = evaluate(vectors(spark, x).repartition(5), labels(spark, 90 - 7 * c)).first()
    assert tuple(one)[:9] == pytest.approx(tuple(other)[:9])


def test_structure_beats_random_labels(spark):
    rng = np.random.default_rng(5)
    c = np.repeat(np.arange(4), 25)
    x = np.eye(4)[c] + rng.normal(scale=0.1, size=(100, 4))
    both = labels(spark, c, 4).unionByName(labels(spark, rng.permutation(c), 4, "baseline_shuffle_size"))
    metrics = evaluate(vectors(spark, x), both)
    best = {r.metric: r.variant for r in report.ranked(metrics).filter("rank = 1").collect()
            if r.metric not in ("singleton_ratio", "cosine_inter")}
    assert set(best.values()) == {"kmeans"}
    scaled = {(r.metric, r.variant): r.scaled for r in report.scaled(metrics).collect()}
    assert scaled["dbi", "kmeans"] == 1 and scaled["dbi", "baseline_shuffle_size"] == 0
    assert scaled["singleton_ratio", "kmeans"] == 0


@pytest.mark.parametrize("clusters", [[0, 0, 1], [0, 0, 1, 1, 1]])
def test_ids_that_one_side_lacks_fail_the_job(spark, clusters):
    with pytest.raises(Exception, match="do not hold the same ids"):
        Evaluation(vectors(spark, PAIRS), labels(spark, clusters)).table().first()
