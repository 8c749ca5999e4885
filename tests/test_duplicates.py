import numpy as np
import pytest
from helpers import vectors

from shoal.operators import proximity
from shoal.plans import duplicates


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.5, (60, 4)) for c in rng.normal(0, 1, (4, 4))])
    return np.vstack([x, np.tile(x[:1], (30, 1)), np.zeros((3, 4)), x[5:8] * 3])


def brute(x, cluster, least):
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.where(norms, norms, 1)[:, None]
    alike = (unit @ unit.T >= least - 1e-9) & (cluster[:, None] == cluster[None])
    np.fill_diagonal(alike, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([root[i], *root[alike[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    return root, alike


@pytest.mark.parametrize("tile_rows, least", [(2048, 0.9), (32, 0.9)])
def test_classes_against_brute_force(spark, cloud, tile_rows, least):
    cluster = np.arange(len(cloud)) % 3
    cluster[240:270] = 0
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cluster)], "question_id long, cluster_id int")
    members, pairs = duplicates.linked(vectors(spark, cloud), labels, least, tile_rows)
    got = {r.question_id: r for r in members.collect()}
    root, alike = brute(cloud, cluster, least)
    assert [got[i].component_id for i in range(len(cloud))] == list(root)
    assert [got[i].links for i in range(len(cloud))] == list(alike.sum(1))
    assert all(got[i].rep == 0 for i in range(240, 270))
    found = pairs.collect()
    assert len({(r.id_a, r.id_b) for r in found}) == len(found)
    near = np.arange(len(cloud))
    for r in found:
        assert alike[r.id_a, r.id_b] and r.id_a < r.id_b and r.cosine >= least - 1e-9
    for _ in range(len(cloud)):  # the pairs alone give the classes of the representatives
        for r in found:
            near[r.id_a] = near[r.id_b] = min(near[r.id_a], near[r.id_b])
    reps = sorted({got[i].rep for i in got})
    assert [near[i] for i in reps] == [root[i] for i in reps]


def test_whole_table_without_labels(spark, cloud):
    got = {r.question_id: r for r in duplicates.dedup_candidates(vectors(spark, cloud)).collect()}
    root, alike = brute(cloud, np.zeros(len(cloud)), duplicates.MIN_COSINE)
    assert [(got[i].component_id, got[i].links) for i in range(len(cloud))] == list(zip(root, alike.sum(1)))
    with pytest.raises(ValueError):
        duplicates.dedup_candidates(vectors(spark, cloud), min_cosine=0.0)


def test_sketch_distances_are_lower_bounds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 30)) * np.linspace(3, 0.1, 30)
    sketch = proximity.Sketch.of(x[:50], 4)
    s = sketch(x)
    real = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert (np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1)) <= real + 1e-9).all()
    assert s.shape == (200, 5)


def test_tree_has_bounded_tiles_and_true_boxes(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(9, 1e-4, (300, 3))])  # a crowd that one pivot may take whole
    points, _ = proximity.distinct_points(vectors(spark, x))
    tree = proximity.build_tree(points, 16)
    rows = tree.rows.collect()
    assert sorted(r.id for r in rows) == list(range(700))
    by_tile, by_group = {}, {}
    for r in rows:
        by_tile.setdefault(r.tile, []).append(r)
        by_group.setdefault(r.grp, []).append(r)
    assert max(map(len, by_tile.values())) <= 48 and max(map(len, by_group.values())) <= 48 * proximity.GROUP_TILES
    for t in tree.tiles.collect():
        inside = tree.sketch(np.array([r.vec for r in by_tile[t.tile]]))
        assert t.n == len(inside) and np.allclose(inside.min(0), t.low) and np.allclose(inside.max(0), t.high)
        assert {r.grp for r in by_tile[t.tile]} == {t.grp}


def test_far_tiles_are_not_sent(spark):
    x = np.vstack([np.random.default_rng(i).normal(100 * i, 1, (64, 3)) for i in range(6)])
    points, _ = proximity.distinct_points(vectors(spark, x))
    tree = proximity.build_tree(points, 32)
    from pyspark.sql import functions as F

    routes = proximity._routes(tree, tree.rows.withColumn("reach", F.lit(5.0))).collect()
    everything = proximity._routes(tree, tree.rows.withColumn("reach", F.lit(1e9))).count()
    assert len(routes) < everything / 2
    assert {r.tile for r in routes} == {r.tile for r in tree.tiles.collect()}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert duplicates.dedup_candidates(none).count() == 0
    assert proximity.neighbour_counts(none, 0.5).count() == 0
    assert proximity.k_distance(none, 3).count() == 0
