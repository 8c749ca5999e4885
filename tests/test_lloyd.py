import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from shoal.plans import baselines, kmeans, lloyd


def plain(x, centres, max_iter, tolerance):
    centres = centres.copy()
    for step in range(max_iter):
        labels = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = centres.copy()
        for c in range(len(centres)):
            if (labels == c).any():
                new[c] = x[labels == c].mean(0)
        moved = np.sqrt(((new - centres) ** 2).sum(1)).max()
        centres = new
        if moved <= tolerance:
            break
    d2 = ((x[:, None] - centres[None]) ** 2).sum(-1)
    return d2.argmin(1), d2.min(1).sum(), step + 1


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    return np.vstack([rng.normal(c, 0.4, (120, 5)) for c in rng.normal(0, 1.5, (6, 5))] + [np.zeros((9, 5))])


@pytest.mark.parametrize("max_iter", [1, 3, 40])
def test_each_run_is_its_own_lloyd_run(spark, cloud, max_iter):
    rng = np.random.default_rng(6)
    starts = {k: cloud[rng.choice(len(cloud), k, replace=False)] for k in (1, 2, 5, 13, 40)}
    joint = lloyd.joint_fit(vectors(spark, cloud).repartition(3), starts, max_iter=max_iter)
    rows = {r.id: r.labels for r in joint.rows.collect()}
    for i, k in enumerate(joint.ks):
        labels, cost, steps = plain(cloud, starts[k], max_iter, lloyd.TOLERANCE)
        assert [rows[j][i] for j in range(len(cloud))] == list(labels), k
        assert np.isclose(joint.fits[k].cost, cost) and joint.fits[k].iterations == steps
    assert joint.fits[1].settled == (max_iter > 1)


def test_an_empty_cluster_keeps_its_centre(spark):
    x = np.array([[0.0], [0.1], [5.0]])
    starts = {3: np.array([[0.0], [5.0], [100.0]])}
    joint = lloyd.joint_fit(vectors(spark, x), starts)
    assert joint.fits[3].centres[2] == 100.0
    assert {r.cluster_id for r in joint.assignments().collect()} == {0, 1}


def test_groups_hold_what_fits():
    assert lloyd.groups_of([3, 1, 2], 10, 8 * 30) == [[1, 2], [3]]
    with pytest.raises(ValueError):
        lloyd.groups_of([5], 10, 8 * 30)


def test_seeds_are_drawn_by_distance_and_do_not_depend_on_other_ks(spark):
    rng = np.random.default_rng(1)
    far = np.vstack([rng.normal(0, 0.01, (300, 2)), [[50.0, 0.0], [0.0, 50.0], [-50.0, 0.0]]])
    both = baselines.all_seeds(vectors(spark, far), [4, 7])
    assert {300, 301, 302} <= set(both[4][0].tolist()) | set(both[7][0].tolist())
    assert {300, 301, 302} <= set(both[4][0].tolist())  # rows far from all others are always drawn
    alone = baselines.all_seeds(vectors(spark, far).repartition(4), [4])
    assert list(alone[4][0]) == list(both[4][0]) and np.allclose(far[both[7][0]], both[7][1])


def test_search_reports_what_it_cannot_fit_and_final_labels_are_nearest(spark, cloud):
    found = kmeans.search(vectors(spark, cloud[:40]), [2, 4, 41])
    assert set(found.failed) == {41} and sorted(r.k for r in found.search.collect()) == [2, 4]
    labels = {r.question_id: r.cluster_id for r in kmeans.final_labels(vectors(spark, cloud), found).collect()}
    centres = found.best_fit.centres
    want = ((cloud[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert [labels[i] for i in range(len(cloud))] == list(want)
    one = kmeans.search(vectors(spark, np.zeros((3, 2))), [1, 2])
    assert set(one.failed) == {1, 2} and one.best_k is None
    with pytest.raises(Exception):
        kmeans.search(vectors(spark, cloud).withColumn("vec", F.raise_error(F.lit("broken")).cast("array<double>")), [2])


def test_minibatch_follows_its_definition(spark, cloud):
    import hashlib

    from shoal.plans.minibatch import minibatch_fit

    starts = cloud[[0, 130, 250, 370, 490, 610]]
    centres, steps = minibatch_fit(vectors(spark, cloud).repartition(3), 6, batch_rows=100, max_epochs=2, patience=100, starts=starts)
    order = sorted(range(len(cloud)), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
    want, taken, done = starts.copy(), np.zeros(6), 0
    for _ in range(2):
        for a in range(0, len(order), 100):
            x = cloud[order[a:a + 100]]
            label = ((x[:, None] - want[None]) ** 2).sum(-1).argmin(1)
            for c in range(6):
                if (label == c).any():
                    n = (label == c).sum()
                    want[c] = (want[c] * taken[c] + x[label == c].sum(0)) / (taken[c] + n)
                    taken[c] += n
            done += 1
    assert steps == done and np.allclose(centres, want)
    assert minibatch_fit(vectors(spark, cloud), 6, batch_rows=4096, patience=3)[1] < 100 * 1
