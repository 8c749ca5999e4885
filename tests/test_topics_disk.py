"""What the topic queries leave and keep in the shared folder."""

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shoal.operators import grams
from shoal.plans import subclusters, topics
from shoal.session import checkpoint_dir

TITLES = [(i, f"alpha beta w{i % 7} w{i % 5} w{i % 7}") for i in range(60)] + [(3, "alpha alpha gamma"), (None, "beta gamma"), (61, ""), (62, None)]


def folder_of(spark):
    return urlparse(checkpoint_dir(spark)).path


def kept(spark, *names):
    return {d for d in os.listdir(folder_of(spark)) if d.split("-")[0] in names}


def test_tables_of_the_topic_step_go_with_it(spark):
    titles = spark.createDataFrame(TITLES, "id long, title string")
    before = kept(spark, "words", "occurrences", "weights", "packed", "grams")
    tree = topics.extract_subtopics(titles, 2, [])
    assert sum(r["size"] for r in tree.collect()) == len(TITLES)
    assert kept(spark, "words", "occurrences", "weights", "packed", "grams") == before


def test_words_are_kept_once_to_a_block(spark, monkeypatch):
    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 9)]) for i in range(60)] + [(None, ["w1"]), (7, None)]
    table = spark.createDataFrame(rows, "id long, words array<string>").coalesce(1)
    whole = grams.packed_words(table, F.col("words"))
    assert sorted(whole.columns) == ["ids", "lengths", "places", "words"] and whole.count() == 1
    assert sorted(whole.first()["words"]) == [f"w{i}" for i in range(7)]  # each once; the words and two hashes of each before
    monkeypatch.setattr(grams, "BLOCK_WORDS", 20)
    blocks = grams.packed_words(table, F.col("words"))
    assert blocks.count() > 5
    for found in (whole, blocks):
        batches = grams._columns(found, "id", "words", "h1").toArrow().to_batches()
        back = [r for b in grams._rows(iter(batches)) for r in b.to_pylist()]
        assert sorted(((r["id"] or -1, r["words"]) for r in back), key=repr) == sorted(((i or -1, w or []) for i, w in rows), key=repr)
        assert len({(w, h) for r in back for w, h in zip(r["words"], r["h1"])}) == 7
    plain = [grams.most_frequent(w, 1, 3, 20) for w in (grams.hashed_words(table, F.coalesce("words", F.array().cast("array<string>"))), whole, blocks)]
    for other in plain[1:]:
        assert other.rows == plain[0].rows == len(rows)
        assert other.terms.orderBy("code").collect() == plain[0].terms.orderBy("code").collect()
        assert sorted(map(tuple, other.counts.collect()), key=repr) == sorted(map(tuple, plain[0].counts.collect()), key=repr)


def test_counts_give_the_weights_and_the_topics(spark):
    titles = spark.createDataFrame(TITLES, "id long, title string")
    terms = topics.title_terms(topics.title_words(titles, []))
    counts, weights = topics.counted(terms), topics.weighted(terms)
    assert not counts.single  # an id comes twice
    clusters = titles.select("id", F.pmod(F.coalesce("id", F.lit(0)), F.lit(2)).alias("cluster_id"))
    short, long = (subclusters.packed(w, clusters).toArrow().to_batches() for w in (counts, weights))

    def cells(batches, factors):
        out = []
        for b in batches:
            offsets, codes, w = subclusters.row_cells(b, factors)
            out += [(i, c, codes[s:e].tolist(), np.sort(np.round(w[s:e], 9)).tolist())
                    for i, c, s, e in zip(b["id"].to_pylist(), b["cluster"].to_pylist(), offsets, offsets[1:])]
        return sorted(out, key=repr)

    assert cells(short, counts.factors) == cells(long, None)
    found = subclusters.subtopics_of_clusters(counts, clusters, 2, with_sums=True)
    other = subclusters.subtopics_of_clusters(weights, clusters, 2)
    by = ["cluster_id", "id", "subtopic"]
    assert found.labels.select(*by).orderBy(*by).collect() == other.labels.select(*by).orderBy(*by).collect()
    by = ["cluster_id", "subtopic", "rank"]
    best = [sorted((r.cluster_id, r.subtopic, r["rank"], r.term, round(r.weight, 9)) for r in t.collect()) for t in (
        topics.top_terms(None, found.labels, terms=terms, sums=found.sums), topics.top_terms(weights, found.labels, terms=terms))]
    assert best[0] == best[1] and best[0]


def test_a_batch_is_met_in_pieces(monkeypatch):
    monkeypatch.setattr(subclusters, "CELLS_AT_ONCE", 6)
    codes = [np.arange(n, dtype=np.int32) for n in (2, 3, 0, 9, 1, 4)]
    batch = pa.table({"cluster": [0, 0, 1, 1, 0, 1], "codes": [c.tobytes() for c in codes],
                      "weights": [np.ones(len(c)).tobytes() for c in codes]}).to_batches()[0]
    met = [(c, part.codes.tolist()) for _, c, part in subclusters._by_cluster(iter([batch]), subclusters._Places(), None)]
    assert met == [(0, [0, 1, 0, 1, 2]), (1, []), (1, list(range(9))), (0, [0]), (1, [0, 1, 2, 3])]


def test_sample_titles_with_labels_that_have_none(spark):
    titles = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (5, "e")], "id long, title string")
    labels = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (2, 1), (3, 1), (5, 1)], "id long, subtopic int")
    got = sorted((r.subtopic, r["rank"], r.id) for r in topics.sample_titles(titles, labels, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (1, 1, 2), (1, 2, 5)]


def test_tables_of_many_clusters_go_too(spark):
    titles = spark.createDataFrame(TITLES, "id long, title string")
    clusters = titles.select("id", F.pmod(F.coalesce("id", F.lit(0)), F.lit(7)).alias("cluster_id"))
    names = ("words", "occurrences", "weights", "packed", "grams", "sums")
    before = kept(spark, *names)
    tree = topics.topics_of_clusters(titles, clusters, 2, []).collect()
    assert sum(r["size"] for r in tree) == len(TITLES) and {r.cluster_id for r in tree} == set(range(7))
    assert kept(spark, *names) == before
