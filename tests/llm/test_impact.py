"""Exact top-k against all inner products, and upper bounds against exact scores."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoal.llm import impact

VECTORS = "vec_id long, embedding array<float>, label int, line string, vec string, rows int, score double"


def table(spark, rows):
    """Vectors with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "l", "v", 2, 0.5) for r in rows], VECTORS)


def odd_rows(n, width):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)]) for i in range(n)]
    hot = [0.5] * width
    rows += [(n + i, hot) for i in range(n // 2)]  # copies tie
    rows += [(5000, None), (5050, []), (5100, [0.1]), (5150, [0.0] * width), (5200, [1e30] * 2), (5250, [-1e30, 1e30])]
    rows += [(5300, [0.1, None]), (5350, [float("nan")]), (5400, [float("inf"), 0.0]), (None, [0.3] * width), (0, [0.2] * width), (0, [0.2] * width)]
    return rows


def brute(rows, k):
    whole = []
    for line, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = np.asarray(v, np.float32).astype(np.float64) * 256
            whole.append((line, i, [math.floor(min(max(x, -impact.LIMIT), impact.LIMIT)) for x in v]))
    out = []
    for line, i, q in whole:
        if i is not None and i % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, other) for other, j, v in whole if other != line))
            out += [(i, r + 1, None if s[1] else s[2], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, width, shard, block", [(300, 16, 64, 1 << 20), (200, 3, 4096, 100)])
def test_top_k(spark, monkeypatch, n, width, shard, block):
    monkeypatch.setattr(impact, "shard_rows", lambda w: shard)
    rows = odd_rows(n, width)
    got = impact.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, 5, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 5)


def test_few_rows_and_empty(spark):
    asks = F.col("vec_id") % 50 == 0
    assert impact.top_k(table(spark, []), asks).count() == 0
    assert impact.top_k(table(spark, [(1, [0.5])]), asks).count() == 0
    assert impact.top_k(table(spark, [(50, [0.5])]), asks).count() == 0
    got = impact.top_k(table(spark, [(50, [0.5, 0.25]), (1, [0.5])]), asks).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 128 * 128)]


@pytest.mark.parametrize("share", [0.05, 0.3, 0.7, 1.0])
def test_bounds_hold(share):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 40, (500, 12))).astype(np.int32)
    v[100:200] = v[100]
    shard = indexed(v)
    for _ in range(20):
        q = np.floor(rng.normal(0, 40, 12))
        q[rng.integers(12)] = 0
        upper = shard.bounds(q, share)
        assert (upper >= v @ q).all()
    assert (shard.bounds(np.zeros(12), share) == 0).all()


def indexed(v):
    rows = pa.table({"line": pa.array(range(len(v)), pa.int64()), "vec_id": pa.array(range(len(v)), pa.int64()), "vec": pa.array(v.tolist(), pa.list_(pa.int32()))})
    return impact.Shard(impact.shard_of(rows, v.shape[1]), v.shape[1])
