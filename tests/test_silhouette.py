"""The silhouette of all rows, and the query that reports it."""

import math

import numpy as np
import pytest
from helpers import labels, vectors

from shoal.catalog import metrics as catalog
from shoal.plans import metrics


def silhouettes(x, c, cosine=False):
    d = 1 - x @ x.T if cosine else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, 0)
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("tile_rows, columns", [(None, 256), (16, 256), (7, 2)])
def test_all_rows_against_brute_force(spark, monkeypatch, tile_rows, columns):
    monkeypatch.setattr(metrics, "SILHOUETTE_COLUMNS", columns)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(130, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[8]
    c = {2: rng.integers(0, 2, 130), 9: np.append(rng.integers(0, 8, 129), 50)}
    given = labels(spark, c[2], 2).unionByName(labels(spark, c[9], 9))
    ev = metrics.Evaluation(vectors(spark, x), given)
    for metric in ("euclidean", "cosine"):
        found = metrics.whole_silhouette(ev.labelled, ev.means, metric, tile_rows)
        got = {r.k: r.silhouette for r in ev.named(found).collect()}
        assert got == pytest.approx({k: silhouettes(x, own, metric == "cosine") for k, own in c.items()}, abs=1e-9)
    part = {r.k: r.silhouette for r in ev.named(ev.silhouette(20)).collect()}
    whole = {r.k: r.silhouette for r in ev.named(ev.silhouette(None)).collect()}
    assert whole == pytest.approx(got, abs=1) and whole != pytest.approx(part, abs=1e-6)


def test_scaled_metrics_do_not_sample(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    given = rng.integers(0, 10, 90)
    spark.createDataFrame([(i, [float(v) for v in row], int(given[i])) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "x" * (i % 31 + 1), i % 31 + 1) for i in range(90)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog, "SAMPLE", 12)
    got = {(r.k, r.variant): r.scaled for r in catalog.metrics_scaled(spark, str(tmp_path)).collect() if r.metric == "silhouette"}
    own = {}
    for r in catalog.assignments(spark, str(tmp_path)).collect():
        own.setdefault((r.k, r.variant), {})[r.question_id] = r.cluster_id
    raw = {key: round(silhouettes(unit, np.array([c[i] for i in range(90)])), 6) for key, c in own.items()}
    for key, value in raw.items():
        of_k = [v for (k, _), v in raw.items() if k == key[0]]
        want = (value - min(of_k)) / ((max(of_k) - min(of_k)) or 1)
        assert math.isclose(got[key], want, abs_tol=1e-3), key


def test_only_the_scaled_metrics_have_no_sample_in_their_statement():
    limit = f"LIMIT {catalog.SAMPLE}"
    assert limit not in catalog.SQL["metrics_scaled"] and limit in catalog.SQL["metric_table"]
