import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import grams
from shoal.plans import topics
from shoal.plans.subclusters import subtopics_of_clusters


def texts(n, words, seed):
    rng = random.Random(seed)
    rows = [(i, [f"w{min(int(rng.expovariate(0.15)), words)}" for _ in range(rng.randint(0, 30))]) for i in range(n)]
    return rows + [(n, []), (n + 1, ["w1"] * 400), (n + 2, ["once", "only", "here"])]


def brute(rows, low, high, terms):
    total, df = Counter(), Counter()
    for _, words in rows:
        own = Counter(" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))
        total.update(own)
        df.update(own.keys())
    return [(t, total[t], df[t]) for t in sorted(total, key=lambda t: (-total[t], t))[:terms]]


@pytest.mark.parametrize("low, high, terms", [(1, 5, 30), (1, 5, 400), (1, 3, 100_000), (2, 4, 50), (1, 1, 5), (1, 5, 0)])
def test_most_frequent_against_counting_everything(spark, low, high, terms):
    rows = texts(150, 25, terms)
    words = grams.hashed_words(spark.createDataFrame(rows, "id long, words array<string>").repartition(4), F.col("words"))
    found = grams.most_frequent(words, low, high, terms)
    got = [(r.term, r.total, r.df) for r in found.terms.orderBy("code").collect()]
    assert got == brute(rows, low, high, terms)
    names = {r.code: r.term for r in found.terms.collect()}
    per_row = {(r.id, names[r.code]): r.tf for r in found.counts.collect()}
    kept = {t for t, _, _ in got}
    want = Counter((i, g) for i, w in rows for n in range(low, high + 1) for g in (" ".join(w[k:k + n]) for k in range(len(w) - n + 1)) if g in kept)
    assert per_row == dict(want)


def test_no_words_at_all(spark):
    for rows in ([], [(1, []), (2, None)]):
        words = grams.hashed_words(spark.createDataFrame(rows, "id long, words array<string>"), F.coalesce("words", F.array().cast("array<string>")))
        found = grams.most_frequent(words, 1, 5, 10)
        assert found.terms.count() == found.counts.count() == 0


def test_subclusters_of_many_clusters(spark):
    rng = np.random.default_rng(2)
    rows, clusters, want = [], [], {}
    for cluster in range(4):
        for i in range(60):
            name = cluster * 100 + i
            group = i % 3
            for code in rng.choice(10, 4, replace=False):
                rows.append((name, int(cluster * 40 + group * 10 + code), 0.5))
            clusters.append((name, cluster))
            want[name] = (cluster, group)
    clusters += [(900, 9), (901, 9), (902, 3)]  # no terms at all
    weights = spark.createDataFrame(rows, "id long, code int, weight double")
    table = spark.createDataFrame(clusters, "id long, cluster_id long")
    whole = subtopics_of_clusters(weights, table, 3)
    got = {r.id: (r.cluster_id, r.subtopic) for r in whole.labels.collect()}
    assert set(got) == {c for c, _ in clusters}
    pairs = {(want[i], got[i]) for i in want}
    assert len(pairs) == 12 and len({a for a, _ in pairs}) == 12  # each group of terms is a subtopic of its cluster
    alone = subtopics_of_clusters(weights, table.filter("cluster_id = 2"), 3)
    assert {r.id: r.subtopic for r in alone.labels.collect()} == {i: s for i, (c, s) in got.items() if c == 2}
    split = subtopics_of_clusters(weights, table, 3, limit_bytes=4000)
    assert {r.id: (r.cluster_id, r.subtopic) for r in split.labels.collect()} == got
    for r in whole.distances.filter("cluster_id < 4").collect():
        centres = whole.centres[r.cluster_id]
        row = np.zeros(200)
        for i, code, w in rows:
            if i == r.id:
                row[code] = w
        dense = np.zeros((len(centres.matrix), 200))
        dense[:, centres.codes] = centres.matrix
        d2 = ((dense - row) ** 2).sum(1)
        assert np.isclose(r.distance, d2.min(), atol=1e-9) and np.isclose(d2[r.subtopic], d2.min(), atol=1e-9)


def test_trees_of_clusters(spark):
    titles = spark.createDataFrame([(i, f"alpha beta {i % 2}{i % 2}" if i < 8 else "gamma delta") for i in range(12)], "id long, title string")
    clusters = titles.select("id", F.when(F.col("id") < 8, 1).otherwise(2).alias("cluster_id"))
    tree = topics.topics_of_clusters(titles, clusters, 2, []).collect()
    assert sum(r["size"] for r in tree) == 12 and {r.cluster_id for r in tree} == {1, 2}
    assert all(set(r.terms) <= {"gamma", "delta", "gamma delta"} for r in tree if r.cluster_id == 2)


def cloud_terms(texts, stop, least):
    """Counts by the definition: closing 's cut, no numbers, plurals under their singular, collocations taken off their words."""
    import math
    import re

    def merged(counts):
        return {t: t[:-1] if re.search("[^s]s$", t) and t[:-1] in counts else t for t in counts}

    def likelihood(k, n, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)

    words = [[re.sub("'s$", "", w) for w in re.findall(r"\w[\w']+", t.lower())] for t in texts]
    words = [[w for w in ws if not w.isdecimal()] for ws in words]
    own = Counter(w for ws in words for w in ws if w not in stop)
    pairs = Counter(f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:]) if a not in stop and b not in stop)
    standard, total = merged(own), Counter()
    for w, c in own.items():
        total[standard[w]] += c
    both = Counter()
    for p, c in pairs.items():
        both[merged(pairs)[p]] += c
    n, out = sum(own.values()), Counter(total)
    for p, c in both.items():
        a, b = (standard[w] for w in p.split(" "))
        ca, cb = total[a], total[b]
        score = -2 * (likelihood(c, ca, cb / n) + likelihood(cb - c, n - ca, cb / n) - likelihood(c, ca, c / ca) - likelihood(cb - c, n - ca, (cb - c) / max(n - ca, 1)))
        if score > least:
            out[a] -= c
            out[b] -= c
            out[p] = c
    return sorted(((t, c) for t, c in out.items() if c > 0), key=lambda r: (-r[1], r[0]))


def test_word_frequencies_merge_plurals_and_drop_numbers(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["cat", "cats", "dog's", "dogs", "glass", "12", "2024", "data base", "data bases", "the", "x9"]) for _ in range(12)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    for least in (1.0, 30.0):
        got = [(r.term, r["count"]) for r in topics.term_frequencies(rows, ["the"], 1000, least).collect()]
        assert got == cloud_terms(texts, {"the"}, least)
        assert "cats" not in dict(got) and "12" not in dict(got) and "glass" in dict(got)
    assert topics.term_frequencies(spark.createDataFrame([], "id long, title string"), []).count() == 0
