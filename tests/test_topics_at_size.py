"""The topic step in bounded pieces: what a task holds, rows packed by document, and joins without a crowded key."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shoal.operators import grams
from shoal.operators.encode import hashed_tfidf
from shoal.plans import subclusters, topics

TITLES = [(1, "red fox red fox"), (2, "blue whale sings"), (2, "red whale"), (3, ""), (None, "red fox"), (None, "whale sings"), (4, "fox"), (5, "blue sky blue sky")]


def test_a_task_works_on_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(grams, "WORDS_AT_ONCE", 10)
    lists = [list(range(n)) for n in (3, 4, 3, 0, 25, 1, 9, 9, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int64()))], names=["id", "h1"])
    parts = list(grams._pieces(iter([batch.slice(0, 0), batch])))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(lists)))
    assert [sum(len(x) for x in p.column("h1").to_pylist()) for p in parts] == [10, 25, 10, 9]


def test_pieces_do_not_change_the_terms(spark, monkeypatch):
    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 9)]) for i in range(60)]
    words = grams.hashed_words(spark.createDataFrame(rows, "id long, words array<string>").coalesce(1), F.col("words"))
    whole = grams.most_frequent(words, 1, 3, 20)
    want = [whole.terms.orderBy("code").collect(), whole.counts.orderBy("id", "code").collect()]
    texts = [t for t in grams._pieces(iter(words.toArrow().to_batches()))]
    assert len(texts) >= 1
    monkeypatch.setattr(grams, "WORDS_AT_ONCE", 1)
    batch = words.select("h1", "h2").toArrow().combine_chunks().to_batches()
    small = list(grams._tally(iter(batch), [], 1, 0))
    monkeypatch.undo()
    large = list(grams._tally(iter(batch), [], 1, 0))
    assert [b.to_pydict() for b in small] == [b.to_pydict() for b in large]
    assert len(want[0]) == 20 and whole.cells.count() == len({r.id for r in want[1]})  # a row to a document with terms


def test_weights_are_a_row_to_a_document(spark):
    titles = spark.createDataFrame(TITLES, "id long, title string")
    terms = topics.title_terms(topics.title_words(titles, []))
    rows = topics.weighted(terms)
    assert rows.count() == terms.cells.count() == 7
    squares = {}
    for r in rows.collect():
        assert [c.code for c in r.cells] == sorted(c.code for c in r.cells)
        squares[r.id] = squares.get(r.id, 0.0) + sum(c.weight ** 2 for c in r.cells)
    assert all(abs(s - 1) < 1e-9 for s in squares.values()) and set(squares) == {1, 2, 4, 5, None}
    got = {(r.id, r.code, r.tf, round(r.weight, 9)) for r in topics.tfidf(terms).collect()}
    assert got == {(r.id, c.code, c.tf, round(c.weight, 9)) for r in rows.collect() for c in r.cells}


def test_packed_and_long_weights_give_the_same_topics(spark):
    titles = spark.createDataFrame(TITLES, "id long, title string")
    terms = topics.title_terms(topics.title_words(titles, []))
    clusters = titles.select("id", F.lit(0).alias("cluster_id"))
    for one, other in zip(*(subclusters.packed(w, clusters).orderBy("id").collect() for w in (topics.weighted(terms), topics.tfidf(terms)))):
        assert (one.id, one.cluster) == (other.id, other.cluster) and one.codes == other.codes
        assert np.allclose(np.sort(np.frombuffer(one.weights)), np.sort(np.frombuffer(other.weights)))
    labels = titles.select("id", F.pmod(F.coalesce("id", F.lit(0)), F.lit(2)).cast("int").alias("subtopic"))
    by = ["subtopic", "rank"]
    long = topics.top_terms(topics.tfidf(terms), labels).orderBy(*by).collect()
    packed = topics.top_terms(topics.weighted(terms), labels, terms=terms).orderBy(*by).collect()
    assert [(r.subtopic, r.rank, r.term, round(r.weight, 9)) for r in long] == [(r.subtopic, r.rank, r.term, round(r.weight, 9)) for r in packed]


def test_places_of_codes_with_and_without_a_table(monkeypatch):
    known, codes = np.array([2, 5, 9], np.int32), np.array([0, 2, 5, 8, 9, 10, 70], np.int32)
    want = [3, 0, 1, 3, 2, 3, 3]
    places = subclusters._Places()
    assert places(known, codes).tolist() == want and places(known[:1], codes).tolist() == [1, 0, 1, 1, 1, 1, 1]
    monkeypatch.setattr(subclusters, "MAX_TABLE", 1)
    assert places(known, codes).tolist() == want


def test_only_plurals_look_for_their_singular(spark):
    counts = spark.createDataFrame([("fox", 3), ("cats", 2), ("cat", 5), ("glass", 1), ("dogs", 4)], "term string, c long")
    merged = topics._merged(counts)
    assert {(r.term, r.c, r.standard) for r in merged.collect()} == {
        ("fox", 3, "fox"), ("cats", 2, "cat"), ("cat", 5, "cat"), ("glass", 1, "glass"), ("dogs", 4, "dogs")}
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isnull(_cut" not in plan.lower()


def test_hashed_vectors_add_up_a_row_to_an_id(spark):
    rows = [(1, ["red", "fox", "red"]), (2, ["blue"]), (2, ["fox", "blue"]), (None, ["red", "sky"]), (3, []), (4, ["sky"])]
    tokens = spark.createDataFrame(rows, "id long, words array<string>")
    found = hashed_tfidf(tokens.repartition(3), 8)
    got = found.collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (True, 0)]
    alike = [np.array(r.vec) for r in got if r.id == 2]
    assert np.allclose(*alike) and abs(np.linalg.norm(alike[0]) - 1) < 1e-9
    assert not any(any(r.vec) for r in got if r.id in (3, None))
    # md5 of a term is taken once for each term, before its rows are met
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
