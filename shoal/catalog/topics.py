"""Topic breakdown queries: word statistics on whole texts, sample titles on first lines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.catalog.common import SEED, SQL_TEXT, SQL_TITLE, sql_bits, table, texts, titles
from shoal.functions.hashing import digest, leading_bits
from shoal.functions.text import TOKEN, WORD
from shoal.functions.vectors import values
from shoal.plans import topics
from shoal.plans.subclusters import row_cells, subtopics_of_clusters
from shoal.session import BROADCAST_BYTES

MAX_TERMS = topics.MAX_TERMS
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "by", "an", "be"]


def _terms(spark, sf_dir):
    return topics.terms_of(texts(spark, sf_dir), STOP_WORDS, MAX_TERMS)


def _labels(spark, sf_dir):
    """Five hash groups of the documents, standing in for sub-clusters."""
    group = F.pmod(leading_bits(digest(F.col("id"), SEED)), F.lit(topics.SUBTOPICS)).cast("int")
    return titles(spark, sf_dir).select("id", group.alias("subtopic"))


def _weights(spark, sf_dir):
    return topics.counted(_terms(spark, sf_dir))


def title_vocabulary(spark, sf_dir):
    return _terms(spark, sf_dir).vocabulary.drop("code").withColumn("idf", F.round("idf", 6))


def title_tfidf(spark, sf_dir):
    return topics.tfidf(_terms(spark, sf_dir)).drop("code").withColumn("weight", F.round("weight", 6))


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def _sources(spark, sf_dir):
    """The documents by language and source, standing in for clusters."""
    name = F.concat_ws(" ", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.pmod(F.xxhash64(name), F.lit(7)).alias("cluster_id"))


def subtopic_labels(spark, sf_dir):
    return topics.subtopics(_weights(spark, sf_dir), _ids(spark, sf_dir))


def subtopic_check(spark, sf_dir):
    """Rows labelled, labels outside [0, k), and rows with another centre of their cluster nearer than their own."""
    return _checked(_weights(spark, sf_dir), _ids(spark, sf_dir).withColumn("cluster_id", F.lit(0))).drop("cluster_id")


def _checked(weights, clusters):
    """Per cluster; the distances are measured anew from the weights and the centres, row by row of the weights that meet a label."""
    found = subtopics_of_clusters(weights, clusters, topics.SUBTOPICS)
    spark, labels, factors, k = weights.rows.sparkSession, found.labels, weights.factors, topics.SUBTOPICS
    id_type = labels.schema["id"].dataType.simpleString()
    lengths = [(c, j, float(n)) for c, m in found.centres.items() for j, n in enumerate(m.lengths)]
    lengths = spark.createDataFrame(lengths, "cluster_id long, centre int, length double")
    parts = []
    for names in _shippable(found.centres):
        shipped = spark.sparkContext.broadcast({c: found.centres[c] for c in names})

        def dots(batches, shipped=shipped):
            for batch in batches:
                offsets, codes, w = row_cells(batch, factors)
                row, out = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), np.zeros((batch.num_rows, k))
                cluster = values(batch.column("cluster_id"))
                for name in np.unique(cluster).tolist():
                    at = np.flatnonzero(cluster[row] == name)
                    own = shipped.value[name]
                    for j, centre in enumerate(own.matrix):
                        of = np.zeros(max(int(codes[at].max(initial=0)), int(own.codes.max(initial=0))) + 1)
                        of[own.codes] = centre
                        out[:, j] += np.bincount(row[at], weights=w[at] * of[codes[at]], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(out[:, j]) for j in range(k)]], names=["id", *[f"d{j}" for j in range(k)]])

        own = labels.filter(F.col("cluster_id").isin(names)).select("id", "cluster_id")
        parts.append(weights.rows.join(own, "id").mapInArrow(dots, f"id {id_type}, " + ", ".join(f"d{j} double" for j in range(k))))
    dots = reduce(DataFrame.unionByName, parts).groupBy("id").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(k)])
    dots = dots.select("id", F.posexplode(F.array(*[f"d{j}" for j in range(k)])).alias("centre", "dot"))
    away = labels.join(F.broadcast(lengths), "cluster_id").join(dots, ["id", "centre"], "left").withColumn(
        "d", F.col("length") - 2 * F.coalesce("dot", F.lit(0.0)))
    own = F.max(F.when(F.col("centre") == F.col("subtopic"), F.col("d")))
    rows = away.groupBy("cluster_id", "id", "subtopic").agg(own.alias("own"), F.min("d").alias("least"))
    outside = F.count(F.when(~F.col("subtopic").between(0, topics.SUBTOPICS - 1), 1))
    return rows.groupBy("cluster_id").agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), outside.alias("outside"),
        F.count(F.when(F.col("own") > F.col("least") + 1e-9, 1)).alias("not_nearest"))


def _shippable(centres):
    """Names of clusters, in groups whose centres fit a broadcast."""
    groups, held = [[]], 0
    for c, m in centres.items():
        size = m.codes.nbytes + m.matrix.nbytes
        if groups[-1] and held + size > BROADCAST_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(c)
        held += size
    return groups


def subtopics_of_sources(spark, sf_dir):
    """The topic trees of all source clusters at once."""
    return topics.topics_of_clusters(texts(spark, sf_dir), _sources(spark, sf_dir), stop_words=STOP_WORDS, shown=titles(spark, sf_dir))


def subtopics_of_clusters_check(spark, sf_dir):
    """The check of every cluster, added up."""
    return _checked(_weights(spark, sf_dir), _sources(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("rows", "ids", "outside", "not_nearest")])


def subtopic_terms(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    best = topics.top_terms(topics.weighted(terms), _labels(spark, sf_dir), terms=terms)
    return best.withColumn("rank", F.col("rank").cast("long")).withColumn("weight", F.round("weight", 6))


def subtopic_titles(spark, sf_dir):
    best = topics.sample_titles(titles(spark, sf_dir), _labels(spark, sf_dir))
    return best.withColumn("rank", F.col("rank").cast("long"))


def topic_tree(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    tree = topics.topic_tree(titles(spark, sf_dir), topics.weighted(terms), _labels(spark, sf_dir), terms)
    return tree.select("subtopic", "size", F.concat_ws(" | ", "terms").alias("terms"),
                       F.concat_ws(" | ", "titles").alias("titles"))


def extracted_subtopics(spark, sf_dir):
    return topics.extract_subtopics(texts(spark, sf_dir), stop_words=STOP_WORDS, shown=titles(spark, sf_dir))


def title_term_frequencies(spark, sf_dir):
    return topics.term_frequencies(texts(spark, sf_dir), STOP_WORDS)


QUERIES = {f.__name__: f for f in (
    title_vocabulary, title_tfidf, subtopic_labels, subtopic_check, subtopic_terms, subtopic_titles, topic_tree,
    extracted_subtopics, subtopics_of_sources, subtopics_of_clusters_check, title_term_frequencies,
)}

_WORD = WORD.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_GRAMS = " UNION ALL ".join(
    f"SELECT id, array_to_string(words[i:i + {n - 1}], ' ') AS term "
    f"FROM (SELECT id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM words WHERE len(words) >= {n})"
    for n in range(topics.NGRAM_RANGE[0], topics.NGRAM_RANGE[1] + 1)
)
_BASE = f"""WITH titles AS (SELECT doc_id AS id, {SQL_TITLE} AS title FROM documents),
texts AS (SELECT doc_id AS id, {SQL_TEXT} AS text FROM documents),
words AS (SELECT id, list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: t NOT IN ({_STOP})) AS words FROM texts),
grams AS ({_GRAMS}),
tf AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df,
    ln((1.0 + (SELECT count(*) FROM titles)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {MAX_TERMS}),
weights AS (SELECT id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight
  FROM tf JOIN vocab USING (term)),
labels AS (SELECT id, CAST({sql_bits(f"md5(id || ':{SEED}')")} % {topics.SUBTOPICS} AS INT) AS subtopic FROM titles),
sizes AS (SELECT subtopic, count(*) AS size FROM labels GROUP BY subtopic),
means AS (SELECT subtopic, term, round(sum(weight) / any_value(size), 12) AS weight
  FROM weights JOIN labels USING (id) JOIN sizes USING (subtopic) GROUP BY subtopic, term),
top_terms AS (SELECT subtopic, row_number() OVER (PARTITION BY subtopic ORDER BY weight DESC, term) AS rank, term, weight
  FROM means QUALIFY rank <= {topics.TOP_TERMS}),
top_titles AS (SELECT subtopic, row_number() OVER (PARTITION BY subtopic ORDER BY id) AS rank, id, title
  FROM titles JOIN labels USING (id) QUALIFY rank <= {topics.SAMPLE_TITLES})
"""


def _ll(k: str, n: str, x: str) -> str:
    return f"(ln(greatest({x}, 1e-10)) * {k} + ln(greatest(1.0 - {x}, 1e-10)) * ({n} - {k}))"


_P, _P1, _P2 = "(cb / n)", "(both_n / ca)", "((cb - both_n) / greatest(n - ca, 1))"
_SCORE = (f"-2.0 * ({_ll('both_n', 'ca', _P)} + {_ll('(cb - both_n)', '(n - ca)', _P)} "
          f"- {_ll('both_n', 'ca', _P1)} - {_ll('(cb - both_n)', '(n - ca)', _P2)})")

_CHECK = """SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, CAST(0 AS BIGINT) AS outside,
  CAST(0 AS BIGINT) AS not_nearest FROM documents"""

SQL = {
    "title_vocabulary": _BASE + "SELECT term, total, df, round(idf, 6) AS idf FROM vocab",
    "title_tfidf": _BASE + "SELECT id, term, tf, round(weight, 6) AS weight FROM weights",
    "subtopic_check": _CHECK,
    "subtopics_of_clusters_check": _CHECK,
    "subtopic_terms": _BASE + "SELECT subtopic, rank, term, round(weight, 6) AS weight FROM top_terms",
    "subtopic_titles": _BASE + "SELECT subtopic, rank, id, title FROM top_titles",
    "topic_tree": _BASE + """SELECT subtopic, size,
        coalesce((SELECT string_agg(term, ' | ' ORDER BY rank) FROM top_terms t WHERE t.subtopic = s.subtopic), '') AS terms,
        coalesce((SELECT string_agg(title, ' | ' ORDER BY rank) FROM top_titles t WHERE t.subtopic = s.subtopic), '') AS titles
      FROM sizes s""",
    "title_term_frequencies": f"""WITH titles AS (SELECT doc_id AS id, {SQL_TEXT} AS title FROM documents),
      found AS (SELECT list_filter(list_transform(regexp_extract_all(lower(title), '{_WORD}'), lambda w: regexp_replace(w, '''s$', '')),
        lambda w: NOT regexp_full_match(w, '\\p{{Nd}}+')) AS words FROM titles),
      words AS (SELECT word AS term, count(*) AS c FROM (SELECT unnest(words) AS word FROM found)
        WHERE word NOT IN ({_STOP}) GROUP BY word),
      singles AS (SELECT w.term, w.c, coalesce(s.term, w.term) AS standard FROM words w
        LEFT JOIN words s ON regexp_matches(w.term, '[^s]s$') AND s.term = w.term[:-2]),
      totals AS (SELECT standard, CAST(sum(c) AS BIGINT) AS c FROM singles GROUP BY standard),
      under AS (SELECT s.term, s.standard, t.c FROM singles s JOIN totals t ON t.standard = s.standard),
      raw_pairs AS (SELECT a || ' ' || b AS term, count(*) AS c FROM (
          SELECT unnest(words[:-2]) AS a, unnest(words[2:]) AS b FROM found WHERE len(words) > 1)
        WHERE a NOT IN ({_STOP}) AND b NOT IN ({_STOP}) GROUP BY 1),
      pairs AS (SELECT coalesce(s.term, p.term) AS term, CAST(sum(p.c) AS BIGINT) AS both_n FROM raw_pairs p
        LEFT JOIN raw_pairs s ON regexp_matches(p.term, '[^s]s$') AND s.term = p.term[:-2] GROUP BY 1),
      scored AS (SELECT p.term, both_n, x.standard AS a, y.standard AS b, x.c AS ca, y.c AS cb, (SELECT sum(c) FROM words) AS n
        FROM pairs p JOIN under x ON x.term = split_part(p.term, ' ', 1) JOIN under y ON y.term = split_part(p.term, ' ', 2)),
      kept AS (SELECT term, a, b, both_n FROM scored WHERE {_SCORE} > {topics.COLLOCATION_SCORE}),
      taken AS (SELECT standard, sum(both_n) AS t FROM (SELECT a AS standard, both_n FROM kept UNION ALL SELECT b, both_n FROM kept) GROUP BY standard)
      SELECT term, CAST(count AS BIGINT) AS count FROM (
        SELECT totals.standard AS term, c - coalesce(t, 0) AS count FROM totals LEFT JOIN taken ON taken.standard = totals.standard
        UNION ALL SELECT term, both_n FROM kept) WHERE count > 0 ORDER BY count DESC, term LIMIT {topics.CLOUD_TERMS}""",
}
