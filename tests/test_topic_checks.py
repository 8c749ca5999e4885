"""The checks of the sub-topics: whole, able to fail, and without a stored table of weights."""

import os
from dataclasses import replace
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from shoal.catalog import topics as catalog
from shoal.plans import topics
from shoal.session import checkpoint_dir


def made(spark):
    titles = spark.createDataFrame([(i, f"alpha w{i % 7} v{i % 5} u{i % 3}") for i in range(80)], "id long, title string")
    counts = topics.counted(topics.title_terms(topics.title_words(titles, [])))
    return counts, titles.select("id", F.pmod("id", F.lit(4)).alias("cluster_id"))


def test_check_of_clusters_finds_labels_that_are_not_nearest(spark, monkeypatch):
    counts, clusters = made(spark)
    for limit in (catalog.BROADCAST_BYTES, 1):  # centres shipped at once, and cluster by cluster
        monkeypatch.setattr(catalog, "BROADCAST_BYTES", limit)
        found = {r.cluster_id: (r.rows, r.ids, r.outside, r.not_nearest) for r in catalog._checked(counts, clusters).collect()}
        assert found == {c: (20, 20, 0, 0) for c in range(4)}
    whole = catalog.subtopics_of_clusters

    def swapped(*args):
        out = whole(*args)
        centres = {c: replace(m, matrix=np.roll(m.matrix, 1, axis=0)) if c == 2 else m for c, m in out.centres.items()}
        return replace(out, centres=centres)

    monkeypatch.setattr(catalog, "subtopics_of_clusters", swapped)
    found = {r.cluster_id: r.not_nearest for r in catalog._checked(counts, clusters).collect()}
    assert found[2] > 0 and found[0] == found[1] == found[3] == 0


def test_check_stores_no_weights(spark, tmp_path):
    rows = [(i, f"alpha w{i % 7} v{i % 5}", "en", f"s{i % 9}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = urlparse(checkpoint_dir(spark)).path
    kept = lambda: {d for d in os.listdir(folder) if d.split("-")[0] in ("weights", "words", "packed")}
    before = kept()
    for query in (catalog.subtopic_check, catalog.subtopics_of_clusters_check):
        assert tuple(query(spark, str(tmp_path)).first()) == (40, 40, 0, 0)
    assert kept() == before
