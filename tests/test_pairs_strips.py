import numpy as np

from shoal.operators import pairs


def test_sums_do_not_depend_on_the_strips(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 1, (90, 4))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g int, vec array<double>")
    monkeypatch.setattr(pairs, "STRIP_ROWS", 7)
    got = {r.g: r for r in pairs.within_group_distances(df, ["g"], 20).collect()}
    for g in (0, 1):
        own = x[g::2]
        d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
        assert abs(got[g].pair_sum - d.sum()) < 1e-6 and abs(got[g].pair_max - d.max()) < 1e-9
