"""Topic breakdown of the titles in a cluster: term weights, sub-clusters, their top terms and sample titles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.text import WORD, tokens
from shoal.functions.vectors import bytes_lists, unstepped, values
from shoal.operators.clusters import top_n_per_group
from shoal.operators.encode import exploded, smooth_idf
from shoal.operators.grams import most_frequent, packed_words, unpacked_cells
from shoal.plans.subclusters import Counts, row_cells, subtopics_of_clusters
from shoal.session import BROADCAST_ROWS, checkpoint, computed_once, dropped, shuffles_dropped, stored

# Fixed values of the breakdown.
NGRAM_RANGE = (1, 5)
MAX_TERMS = 100_000
SUBTOPICS = 5
TOP_TERMS = 7
SAMPLE_TITLES = 5
CLOUD_TERMS = 50
COLLOCATION_SCORE = 30.0
SEED = 42


def english_stop_words() -> list[str]:
    """Spark's own English list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def title_words(titles: DataFrame, stop_words: list[str]) -> DataFrame:
    """The tokens of the titles without stop words, in blocks for counting."""
    return packed_words(titles.select("id", "title"), tokens(F.col("title"), stop_words))


@dataclass
class Terms:
    """`vocabulary(code, term, total, df, idf)` and where its terms occur (see `grams.Vocabulary`); at most `max_terms` terms."""

    vocabulary: DataFrame
    packed: DataFrame
    max_terms: int

    @property
    def cells(self) -> DataFrame:
        """(id, cells(code, tf))"""
        return unpacked_cells(self.packed)

    @property
    def counts(self) -> DataFrame:
        """(id, code, tf)"""
        return self.cells.select("id", F.inline("cells"))


def title_terms(words: DataFrame, max_terms: int = MAX_TERMS) -> Terms:
    """The most frequent 1- to 5-grams of `title_words`, ties by term, and where they occur."""
    found = most_frequent(words, *NGRAM_RANGE, max_terms)
    return Terms(found.terms.withColumn("idf", smooth_idf(F.col("df"), found.rows)), found.packed, max_terms)


def terms_of(titles: DataFrame, stop_words: list[str], max_terms: int = MAX_TERMS) -> Terms:
    """`title_terms` of titles whose words nothing else needs."""
    words = title_words(titles, stop_words)
    found = title_terms(words, max_terms)
    dropped(words)
    return found


def counted(terms: Terms) -> Counts:
    """The weights tf * idf, each title scaled to unit length, as counts. Rows that share an id are scaled together, null ids too."""
    table = terms.vocabulary.select("code", "idf").toArrow()  # bounded by `max_terms`
    idf = np.zeros(table.num_rows)
    idf[values(table.column("code"))] = values(table.column("idf"))
    shipped = terms.packed.sparkSession.sparkContext.broadcast(idf)
    id_type = terms.packed.schema["id"].dataType.simpleString()

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes = bytes_lists(batch.column("codes"), np.int32)
            w = bytes_lists(batch.column("counts"), np.int32)[1] * shipped.value[unstepped(offsets, codes)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(row, weights=w * w, minlength=batch.num_rows).astype(np.float64))], names=["id", "square"])

    # A row alone gives its length itself; only ids that come again need that of all their rows.
    again = terms.packed.mapInArrow(squares, f"id {id_type}, square double").groupBy(F.col("id").alias("_id")).agg(
        F.sqrt(F.sum("square")).alias("norm"), F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_id", "norm")
    again = stored(again, "norms")
    n = again.count()
    rows = terms.packed.select("id", "codes", "counts")
    if n == 0:
        return Counts(rows.withColumn("norm", F.lit(None).cast("double")), shipped, True)
    return Counts(rows.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id"), shipped, False)


def weighted(terms: Terms) -> DataFrame:
    """(id, cells(code, tf, weight)): tf * idf, each title scaled to unit length. Rows that share an id are scaled together, null ids too."""
    found = counted(terms)
    factors, id_type = found.factors, found.rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, w = row_cells(batch, factors)
            tf = bytes_lists(batch.column("counts"), np.int32)[1].astype(np.int64)
            cells = pa.StructArray.from_arrays([pa.array(codes), pa.array(tf), pa.array(w)], names=["code", "tf", "weight"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cells)], names=["id", "cells"])

    return found.rows.mapInArrow(run, f"id {id_type}, cells array<struct<code:int,tf:bigint,weight:double>>")


def _names(terms: Terms) -> DataFrame:
    names = terms.vocabulary.select("code", "term")
    return F.broadcast(names) if terms.max_terms <= BROADCAST_ROWS else names


def tfidf(terms: Terms) -> DataFrame:
    """(id, code, term, tf, weight): the cells of `weighted`, a row to each."""
    return weighted(terms).select("id", F.inline("cells")).join(_names(terms), "code").select("id", "code", "term", "tf", "weight")


def subtopics(weights: DataFrame | Counts, ids: DataFrame, k: int = SUBTOPICS, seed: int = SEED) -> DataFrame:
    """(id, subtopic): k-means on the TF-IDF rows (of `tfidf`, `weighted` or `counted`) of one cluster's titles, `ids(id)`."""
    one = ids.select("id", F.lit(0).alias("cluster_id"))
    return subtopics_of_clusters(weights, one, k, seed).labels.select("id", "subtopic")


def top_terms(weights: DataFrame | None, labels: DataFrame, n: int = TOP_TERMS, terms: Terms | None = None, sums: DataFrame | None = None) -> DataFrame:
    """(subtopic, rank, term, weight): largest mean weights of each subtopic; rows without a term count as 0. `labels` may have a cluster_id.

    `weights` are those of `tfidf`, or those of `weighted` together with their `terms`. Where the `sums(subtopic, code, weight)` by label are
    at hand, they stand for the weights.
    """
    by = [c for c in labels.columns if c in ("cluster_id", "subtopic")]
    sizes = labels.groupBy(*by).agg(F.count("*").alias("size"))
    if sums is not None:
        sums = sums.select(*by, "code", F.col("weight").alias("_sum")).join(_names(terms), "code")
    elif terms is None:
        sums = weights.join(labels, "id").groupBy(*by, "term").agg(F.sum("weight").alias("_sum"))
    else:
        cells = weights.join(labels, "id").select(*by, F.inline("cells"))
        sums = cells.groupBy(*by, "code").agg(F.sum("weight").alias("_sum")).join(_names(terms), "code")
    few = sizes.count() <= BROADCAST_ROWS
    means = sums.join(F.broadcast(sizes) if few else sizes, by).withColumn("weight", F.round(F.col("_sum") / F.col("size"), 12))
    best = top_n_per_group(means, by, [F.col("weight").desc(), "term"], n)
    return best.select(*by, "rank", "term", "weight")


def sample_titles(titles: DataFrame, labels: DataFrame, n: int = SAMPLE_TITLES) -> DataFrame:
    """(subtopic, rank, id, title): the first titles of each subtopic by id. `labels` may have a cluster_id.

    The first labels that have a title hold the first titles, so titles are not shuffled: few labels meet them, measured.
    """
    by = [c for c in labels.columns if c in ("cluster_id", "subtopic")]
    have = labels.select(*by, "id").join(titles.select("id").distinct(), "id", "left_semi")
    first = stored(top_n_per_group(have, by, ["id"], n).select(*by, "id"), "first")
    few = first.count() <= BROADCAST_ROWS
    return top_n_per_group(titles.join(F.broadcast(first) if few else first, "id"), by, ["id"], n).select(*by, "rank", "id", "title")


def topic_tree(titles: DataFrame, weights: DataFrame | None, labels: DataFrame, terms: Terms | None = None, sums: DataFrame | None = None) -> DataFrame:
    """(subtopic, size, terms, titles), at most 7 terms and 5 titles per subtopic; per cluster too if `labels` has a cluster_id.

    `weights`, `terms` and `sums` are as in `top_terms`.
    """
    by = [c for c in labels.columns if c in ("cluster_id", "subtopic")]
    sizes = labels.groupBy(*by).agg(F.count("*").alias("size"))
    terms = top_terms(weights, labels, terms=terms, sums=sums).groupBy(*by).agg(_in_order("term").alias("terms"))
    shown = sample_titles(titles, labels).groupBy(*by).agg(_in_order("title").alias("titles"))
    empty = F.array().cast("array<string>")
    return sizes.join(terms, by, "left").join(shown, by, "left").select(
        *by, "size", F.coalesce("terms", empty).alias("terms"), F.coalesce("titles", empty).alias("titles"))


def _in_order(column: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("rank", column)))
    return F.transform(ordered, lambda r: r[column])


def extract_subtopics(titles: DataFrame, k: int = SUBTOPICS, stop_words: list[str] | None = None,
                      shown: DataFrame | None = None) -> DataFrame:
    """The topic tree of `titles(id, title)`; `shown(id, title)` has other titles to show as samples."""
    one = titles.select("id", F.lit(0).alias("cluster_id"))
    return topics_of_clusters(titles, one, k, stop_words, shown).drop("cluster_id")


def topics_of_clusters(titles: DataFrame, clusters: DataFrame, k: int = SUBTOPICS, stop_words: list[str] | None = None,
                       shown: DataFrame | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """The topic trees (cluster_id, subtopic, size, terms, titles) of the clusters in `clusters(id, cluster_id)`, all in the same jobs.

    The vocabulary is that of all titles together.
    """
    terms = terms_of(titles, english_stop_words() if stop_words is None else stop_words, max_terms)
    found = subtopics_of_clusters(counted(terms), clusters, k, with_sums=True)
    with shuffles_dropped(titles.sparkSession):
        tree = checkpoint(topic_tree(titles if shown is None else shown, None, found.labels, terms, found.sums))
    dropped(terms.packed, found.sums)
    return tree


def _log_likelihood(k: Column, n: Column, x: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.log(F.greatest(x, tiny)) * k + F.log(F.greatest(F.lit(1.0) - x, tiny)) * (n - k)


def collocation_score(both: Column, first: Column, second: Column, words: Column) -> Column:
    """Dunning's log-likelihood ratio of a word pair."""
    p = second / words
    p1 = both / first
    p2 = (second - both) / F.greatest(words - first, F.lit(1))
    return F.lit(-2.0) * (
        _log_likelihood(both, first, p) + _log_likelihood(second - both, words - first, p)
        - _log_likelihood(both, first, p1) - _log_likelihood(second - both, words - first, p2)
    )


def _merged(counts: DataFrame) -> DataFrame:
    """(term, c, standard): a plural in s (not ss) stands under its singular where that occurs too; `c` is the count of the term itself."""
    plural = F.col("term").rlike("[^s]s$")
    singles = counts.select(F.col("term").alias("_single"))
    few = counts.count() <= BROADCAST_ROWS
    # Only plurals look for their singular: the others would all meet in one task, by a null.
    looked = counts.filter(plural).withColumn("_cut", F.expr("substring(term, 1, length(term) - 1)"))
    found = looked.join(F.broadcast(singles) if few else singles, F.col("_cut") == F.col("_single"), "left").select(
        "term", "c", F.coalesce("_single", "term").alias("standard"))
    return counts.filter(~plural).select("term", "c", F.col("term").alias("standard")).unionByName(found)


def term_frequencies(titles: DataFrame, stop_words: list[str], n: int = CLOUD_TERMS,
                     min_score: float = COLLOCATION_SCORE) -> DataFrame:
    """(term, count): most frequent words and collocations of the titles.

    A closing 's is cut off, numbers are dropped, plurals count with their singular. A pair of neighbouring words counts as a
    term when its score passes `min_score`; its occurrences are then taken off the counts of its two words. Titles are tokenised once.
    """
    found = F.regexp_extract_all(F.lower("title"), F.lit(f"({WORD})"), F.lit(1))
    words = F.filter(F.transform(found, lambda w: F.regexp_replace(w, "'s$", "")), lambda w: ~w.rlike(r"^\p{Nd}+$"))
    rows = stored(computed_once(titles.select("id", "title"), words=words).select("id", "words"), "words")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    keep = ~F.col("term").isin(list(stop_words)) if stop_words else F.lit(True)
    counts = checkpoint(exploded(rows, "words", "term").filter(keep).groupBy("term").agg(F.count("*").alias("c")))
    singles = checkpoint(_merged(counts))
    size = F.size("words")
    neighbours = F.arrays_zip(
        F.slice("words", 1, size - 1).alias("a"), F.slice("words", 2, size - 1).alias("b"))
    zipped = rows.select("id", F.when(size > 1, neighbours).alias("pairs"))
    pairs = exploded(zipped, "pairs", "p").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    if stop_words:
        pairs = pairs.filter(~F.col("a").isin(list(stop_words)) & ~F.col("b").isin(list(stop_words)))
    pairs = stored(pairs.groupBy(F.concat_ws(" ", "a", "b").alias("term")).agg(F.count("*").alias("c")), "pairs")
    pairs = _merged(pairs).groupBy(F.col("standard").alias("term")).agg(F.sum("c").alias("both"))
    # What a word counts under, and how often that occurs.
    totals = checkpoint(singles.groupBy("standard").agg(F.sum("c").alias("c")))
    under = few(checkpoint(singles.select("term", "standard").join(few(totals), "standard")))
    total = F.lit(singles.agg(F.sum("c")).first()[0] or 0)
    one = lambda name: under.select(F.col("term").alias(name), F.col("standard").alias(f"{name}_std"), F.col("c").alias(f"c{name}"))
    parts = pairs.select("term", "both", F.split("term", " ")[0].alias("a"), F.split("term", " ")[1].alias("b"))
    scored = parts.join(one("a"), "a").join(one("b"), "b")
    kept = checkpoint(scored.filter(collocation_score(F.col("both"), F.col("ca"), F.col("cb"), total) > min_score))
    taken = kept.select(F.explode(F.array("a_std", "b_std")).alias("standard"), "both").groupBy("standard").agg(
        F.sum("both").alias("taken"))
    alone = totals.join(taken, "standard", "left").select(
        F.col("standard").alias("term"), (F.col("c") - F.coalesce("taken", F.lit(0))).alias("count")).filter("count > 0")
    both = kept.select("term", F.col("both").alias("count"))
    return alone.unionByName(both).orderBy(F.col("count").desc(), "term").limit(n)
