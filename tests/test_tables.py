import json

import numpy as np
import pytest
from helpers import labels, vectors

from shoal.functions.vectors import normalise
from shoal.operators import clusters, membership
from shoal.operators.encode import embed, encoded, hashed_tfidf, quarantine
from shoal.plans import topics
from shoal.sources import schemas, tables


def meta(spark, n):
    return spark.createDataFrame([(i, f'a "q", {i}', 1, 10) for i in range(n)], schemas.METADATA)


def test_json_array_and_lines(spark, tmp_path):
    item = {"question_id": 5, "title": "t", "body": "b", "answers": [{"body": "a", "comments": [{"body": "c"}]}]}
    (tmp_path / "array.json").write_text(json.dumps([item, {"question_id": 6}]))
    rows = tables.read_corpus(spark, str(tmp_path / "array.json")).orderBy("question_id").collect()
    assert [r.question_id for r in rows] == [5, 6] and rows[0].answers[0].comments[0].body == "c"
    tables.write_corpus(tables.read_corpus(spark, str(tmp_path / "array.json")), str(tmp_path / "lines"))
    assert tables.read_corpus(spark, str(tmp_path / "lines"), lines=True).count() == 2


def test_csv_keeps_quotes_and_commas(spark, tmp_path):
    tables.write_csv(meta(spark, 3), str(tmp_path / "m"))
    assert sorted(tables.read_metadata(spark, str(tmp_path / "m")).collect()) == sorted(meta(spark, 3).collect())


def test_assignment_store(spark, tmp_path):
    store = tables.AssignmentStore(spark, str(tmp_path / "a"))
    store.write(labels(spark, [0, 1, 1], 5))
    store.write(labels(spark, [2, 2, 2], 6))
    store.write(labels(spark, [4, 4, 4], 5))  # replaces the first, leaves the second
    assert sorted(r.cluster_id for r in store.read().collect()) == [2, 2, 2, 4, 4, 4]
    assert store.read(9).count() == 0
    with pytest.raises(FileNotFoundError):
        store.read(9, "kmeans", required=True)
    assert sorted(r.k for r in store.labelings().collect()) == [5, 6]


def test_search_log_text(spark, tmp_path):
    log = tables.SearchLog(spark, str(tmp_path / "s"))
    log.append(spark.createDataFrame([(20, 4.1022, 123162.0, 149.15, True)], schemas.SEARCH))
    log.append(spark.createDataFrame([(40, 4.2, 1.0, 2.0, False)], schemas.SEARCH))
    lines = [r.line for r in log.lines().orderBy("k").collect()]
    assert lines == ["[K=20] DBI=4.1022, Inertia=123162.00, Time=149.15s\n   --> New Best K: 20",
                     "[K=40] DBI=4.2000, Inertia=1.00, Time=2.00s"]
    text = spark.createDataFrame([(part,) for line in lines for part in line.split("\n")], "value string")
    assert sorted(tuple(r) for r in tables.parse_search(text).collect()) == [
        (20, 4.1022, 123162.0, 149.15), (40, 4.2, 1.0, 2.0)]


def test_lookups(spark):
    given = labels(spark, [0, 0, 1])
    assert membership.find_question(meta(spark, 3), 1).count() == 1
    with pytest.raises(KeyError):
        membership.find_question(meta(spark, 3), 99)
    with pytest.raises(ValueError):
        membership.aligned(given, meta(spark, 4))
    assert membership.aligned(given, meta(spark, 3)).count() == 3
    members = membership.cluster_of_question(given, meta(spark, 3), 0).collect()
    assert sorted(r.question_id for r in members) == [0, 1]


def test_small_clusters_beside_a_huge_one(spark):
    given = labels(spark, [0] * 3000 + [1] * 10 + [2] * 11 + [3])
    members = clusters.small_cluster_members(given).collect()
    assert {(r.cluster_id, r.cluster_size) for r in members} == {(1, 10), (3, 1)}
    assert len(members) == 11
    totals = {r.k: (r.small_clusters, r.rows) for r in clusters.small_cluster_totals(clusters.small_clusters(given)).collect()}
    assert totals == {2: (2, 11), None: (2, 11)}


def test_size_extremes_keep_ties(spark):
    out = clusters.size_extremes(labels(spark, [0, 0, 1, 1, 2, 3])).collect()
    assert sorted((r.extreme, r.cluster_id) for r in out) == [("max", 0), ("max", 1), ("min", 2), ("min", 3)]


def test_zero_vectors_stay_zero(spark):
    rows = normalise(vectors(spark, [(3, 4), (0, 0)])).orderBy("id").collect()
    assert [r.vec for r in rows] == [[0.6, 0.8], [0.0, 0.0]]


def test_failed_rows_are_quarantined_alone(spark):
    def make():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.array([[len(t), 0.0] for t in texts])
        return encode

    df = spark.createDataFrame([(0, "aa"), (1, "bad"), (2, "c")], "id long, text string").coalesce(1)
    out = embed(df, make)
    assert sorted(r.id for r in encoded(out).collect()) == [0, 2]
    assert [(r.id, r.error) for r in quarantine(out).collect()] == [(1, "RuntimeError: no")]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, ["a", "b"])], "id long, words array<string>")
    rows = [np.array(r.vec) for r in hashed_tfidf(df, 8).orderBy("id").collect()]
    assert np.allclose(rows[0], rows[2]) and rows[0] @ rows[0] == pytest.approx(1) and not rows[1].any()


def test_title_terms_and_weights(spark):
    titles = spark.createDataFrame([(0, "The pl SQL package"), (1, "version control")], "id long, title string")
    words = topics.title_words(titles, ["the"])
    terms = topics.title_terms(words)
    weights = topics.tfidf(terms).collect()
    assert {i: {r.term for r in weights if r.id == i} for i in (0, 1)} == {
        0: {"pl", "sql", "package", "pl sql", "sql package", "pl sql package"}, 1: {"version", "control", "version control"}}
    assert sum(r.weight**2 for r in weights if r.id == 1) == pytest.approx(1)
    few = topics.title_terms(words, 2).vocabulary.orderBy("code").collect()
    assert [r.term for r in few] == ["control", "package"]
