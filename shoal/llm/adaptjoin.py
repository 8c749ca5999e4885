"""Jaccard similarity join on word n-grams with adaptive multi-match prefixes.

A document's set is that of its word n-grams, as 64-bit hashes. All sets share one order: grams that occur rarely first. Of two
sets that are similar enough, the first len - need + m grams of either (need: the least possible overlap) have at least
m grams in common, for any m. Each document picks its own m: it lengthens its prefix while the estimated cost of
what it meets (postings to go through, and candidates to verify) falls. Two documents are held to the smaller m of the two,
and are verified only if that many grams match within the prefixes that their two sizes call for. Posting lists hold
the prefixes for a single match, which every such pair shares one gram of; the longer ones are compared pair by pair.

How often a gram occurs is estimated over all documents by a sketch of fixed size (counters by remainder of the hash, which never count too low);
any common order is right, a better one only makes fewer candidates.

Equal sets count as one: the smallest doc_id stands for its copies. Near-copies come in large groups, whose pairs are never
listed. First each posting list names one document, the one whose prefix holds the commonest grams, and each
document is compared with the one named most often in its lists; what is similar becomes one component. What is left are pairs across components in a posting list, and of those only ones that
the distances to the common document allow (the Jaccard distance is a metric): |d(x, p) - d(y, p)| <= 1 - threshold.
Nothing is capped: a hot posting list is a skewed join, which adaptive execution splits.

Texts without words (null, empty) have an empty set and are linked with nothing, and so are rows whose id is null (their
component is null). Rows that repeat an id are taken to hold the same text, and are copies of each other.
Other columns are ignored. Texts are read whole; very long ones only make long sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import saved, small, without
from shoal.llm.words import shingle_sets
from shoal.operators.components import connected_components

SKETCH_BITS = 20
MAX_SKETCH_BITS = 26
MAX_MATCHES = 32
FLUSH = 1 << 19
TASK_CHARS = 1 << 28
VERIFY_COST = 30.0


def sketch(docs: DataFrame, n: int, text: str, chars: int) -> np.ndarray:
    """About 16 log2 (1 + how often a gram occurs), in a byte for each remainder of the hash, over all documents."""
    bits, pieces = sketch_bits(chars), 64
    width = (1 << bits) // pieces

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            held, size = [], 0
            for grams in shingle_sets(batch.column("text"), n):
                held.append(grams >> np.uint64(64 - bits))
                size += len(grams)
                if size > 1 << 20:
                    _add(total, held)
                    held, size = [], 0
            _add(total, held)
        for k in range(pieces):
            part = total[k * width:(k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([part], pa.list_(pa.int32()))})

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for part in parts:
            for counts in part.column("counts"):
                total += counts.values.to_numpy()
        marks = np.minimum(np.rint(16 * np.log2(1.0 + total)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([marks.tobytes()], pa.binary())})

    # each task hands on its counters, so there are no more of them than the text calls for
    rows = docs.select(F.col(text).cast("string").alias("text")).coalesce(
        max(2 * docs.sparkSession.sparkContext.defaultParallelism, chars // TASK_CHARS))
    summed = rows.mapInArrow(count, "piece int, counts array<int>").groupBy("piece").applyInArrow(add, "piece int, marks binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in summed.collect():
        out[row.piece * width:(row.piece + 1) * width] = np.frombuffer(row.marks, np.uint8)
    return out


def _add(total: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        places, n = np.unique(np.concatenate(held).astype(np.int64), return_counts=True)
        total[places] += n.astype(np.int32)


def sketch_bits(chars: int, least: int = SKETCH_BITS, most: int = MAX_SKETCH_BITS) -> int:
    """So many that about 32 grams share a counter, as far as a byte for each may be sent to every executor."""
    return int(min(most, max(least, math.ceil(math.log2(1 + chars / 6 / 32)))))


def need(size: np.ndarray | int, percent: int):
    """The least overlap of a set of `size` with a similar one, which is then no larger than the set itself."""
    return -(-size * percent // 100)


def prefix(grams: np.ndarray, counts: np.ndarray, percent: int, base: float) -> tuple[np.ndarray, int, float]:
    """(prefix grams, rarest first; matches asked for; mean estimate of its grams).

    With m matches, the first len - need + m grams are the prefix. Postings met are about the sum of the estimates over
    their common level `base`; candidates at most a m-th of it.
    """
    size = len(grams)
    order = np.lexsort((grams, counts))
    least = size - int(need(size, percent))
    most = min(MAX_MATCHES, size - least)
    met = np.cumsum(np.maximum(counts[order] - base, 0.0))
    m = np.arange(1, most + 1)
    cost = met[least + m - 1] * (1.0 + VERIFY_COST / m)
    chosen = int(m[np.argmin(cost)])
    length = least + chosen
    return grams[order[:length]], chosen, float(counts[order[:length]].mean())


def keys(docs: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, size, a, b): the size of each set and two hashes of the whole of it; equal sets have equal ones."""
    def run(batches):
        for batch in batches:
            size, a, b = [], [], []
            for found in shingle_sets(batch.column("text"), n):
                size.append(len(found))
                a.append(int(((found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)))
                b.append(int(((found ^ (found >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
                pa.array(np.array(b, np.uint64).view(np.int64))], names=["doc_id", "size", "a", "b"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, size long, a long, b long")


def _prefixes(docs: DataFrame, n: int, percent: int, marks: np.ndarray):
    """A function from a batch's texts to (set, prefix, matches asked for, mean estimate of its grams) of each."""
    bits = int(np.log2(len(marks)))
    counts = np.exp2(np.arange(256) / 16.0) - 1
    held = docs.sparkSession.sparkContext.broadcast((marks, float(counts[int(np.median(marks))])))

    def of(column):
        table, base = held.value
        for found in shingle_sets(column, n):
            if len(found):
                yield found, *prefix(found, counts[table[(found >> np.uint64(64 - bits)).astype(np.int64)]], percent, base)
            else:
                yield found, found, 0, 0.0

    return of


def postings(docs: DataFrame, prefixes) -> DataFrame:
    """(gram, x, size, at, rank): a row for each gram of `docs(doc_id, text)` that a similar set has to meet one of.

    These are the prefixes for a single match. `at` is the gram's place; `rank` is low where a prefix's grams are common.
    """
    names = ["gram", "x", "size", "at", "rank"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float32()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, kinds)], names=names)

    def run(batches):
        for batch in batches:
            out, waiting = [[] for _ in names], 0
            for doc, (found, first, m, mean) in zip(batch.column("doc_id").to_pylist(), prefixes(batch.column("text"))):
                if m:
                    k = len(first) - m + 1
                    values = first[:k].view(np.int64), np.full(k, doc), np.full(k, len(found)), np.arange(k), np.full(k, -mean)
                    for column, value in zip(out, values):
                        column.append(value)
                    waiting += k
                    if waiting > FLUSH:
                        yield batch_of(out)
                        out, waiting = [[] for _ in names], 0
            if waiting:
                yield batch_of(out)

    return docs.mapInArrow(run, "gram long, x long, size int, at int, rank float")


def _verified(pairs: DataFrame, rows: DataFrame, prefixes, percent: int | None) -> DataFrame:
    """`pairs(x, y)`, a saved table, with the sizes of their sets' intersection and union.

    With `percent`, a pair of which too few grams match in the longer prefixes is not compared further and gets nulls. Sets
    and prefixes are made anew from the texts of the documents in question, so that those of all documents are not kept.
    """
    def run(batches):
        for batch in batches:
            sets, grams, matches = [], [], []
            for found, first, m, _ in prefixes(batch.column("text")):
                sets.append(found.view(np.int64))
                grams.append(first.view(np.int64))
                matches.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64())), pa.array(matches, pa.int32())],
                names=["doc_id", "set", "grams", "matches"])

    ids = saved(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "ids")
    sets = saved(rows.join(small(ids), "doc_id").mapInArrow(
        run, "doc_id long, set array<long>, grams array<long>, matches int"), "sets")
    left = pairs.join(sets.toDF("x", "set_x", "grams_x", "m_x"), "x")
    both = left.join(sets.toDF("y", "set_y", "grams_y", "m_y"), "y")
    total = F.size("set_x") + F.size("set_y")
    common = F.size(F.array_intersect("set_x", "set_y"))
    if percent is not None:
        asked = F.least("m_x", "m_y")
        overlap = F.ceil(total * percent / (100 + percent)).cast("int")
        shown = [F.slice(f"grams_{s}", F.lit(1), F.greatest(F.lit(0), F.size(f"set_{s}") - overlap + asked)) for s in "xy"]
        common = F.when(F.size(F.array_intersect(*shown)) >= asked, common)
    return both.select("x", "y", common.alias("common"), total.alias("total")).select(
        "x", "y", "common", (F.col("total") - F.col("common")).alias("together"))


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(F.col("common") * 100 >= F.col("together") * percent).select("x", "y")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.lit(0).alias("g"), F.col("x").alias("u"), F.col("y").alias("v"))).select("id", "root")


def similar_groups(docs: DataFrame, n: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): the component of each row over links of at least `percent` % similarity.

    `n_copies` counts the rows with the very same set, itself included (0 for an empty set).
    """
    found = saved(keys(docs, n, text, doc_id), "keys")
    own = found.filter("size > 0 and doc_id is not null")
    copies = saved(own.groupBy("a", "b", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
                   .filter("n_copies > 1"), "copies")
    named = saved(own.join(copies, ["a", "b", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "named")

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    others = saved(named.filter("rep <> doc_id").select("doc_id").distinct(), "others")
    single = rows.filter("doc_id is not null").join(small(others), "doc_id", "left_anti")
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    prefixes = _prefixes(docs, n, percent, sketch(docs, n, text, chars))
    lists = postings(single, prefixes)

    pivots = saved(lists.groupBy("gram").agg(F.count("*").alias("met"), F.min(F.struct("rank", "x", "size")).alias("p"))
                   .filter("met > 1").select("gram", "p.x", "p.size").toDF("gram", "pivot", "pivot_size"), "pivots")
    lists = saved(lists.drop("rank").join(pivots, "gram"), "lists")

    # Each document and the pivot it meets most: cheap, and enough to make one component of a large group.
    near = lists.filter(f"x <> pivot and 100 * least(size, pivot_size) >= {percent} * greatest(size, pivot_size)")
    met = near.groupBy("x", "pivot").agg(F.count("*").alias("met"), F.max("size").alias("size"))
    best = met.filter("met >= 2 or size < 20").groupBy("x").agg(F.max(F.struct("met", "pivot")).alias("best"))
    stars = saved(_verified(saved(best.select("x", F.col("best.pivot").alias("y")), "star-pairs"), rows, prefixes, None), "stars")
    first = _components(_linked(stars, percent))

    # What is left: pairs across the components of a posting list.
    placed = saved(lists.join(first.withColumnRenamed("id", "x"), "x", "left").withColumn("root", F.coalesce("root", "x")), "placed")
    mixed = saved(placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("gram"), "mixed")
    known = stars.select("x", F.col("y").alias("pivot"), (1 - F.col("common") / F.col("together")).alias("far"))
    side = placed.join(mixed, "gram").join(known, ["x", "pivot"], "left").withColumn(
        "far", F.when(F.col("x") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("far")))
    side = saved(side.select("gram", "x", "size", "at", "root", "far"), "side")
    other = side.select("gram", *[F.col(c).alias(f"{c}_y") for c in ("x", "size", "at", "root", "far")])
    limit = 1 - percent / 100 + 1e-9
    # the two sizes give the overlap they need, and with it how far a prefix of either goes that has to show a match
    overlap = f"(({percent} * (size + size_y) + {99 + percent}) div {100 + percent})"
    pairs = side.join(other, "gram").filter(
        f"x < x_y and root <> root_y and 100 * least(size, size_y) >= {percent} * greatest(size, size_y)"
        f" and at <= size - {overlap} and at_y <= size_y - {overlap}"
        f" and coalesce(abs(far - far_y) <= {limit}, true)")
    pairs = saved(pairs.select("x", F.col("x_y").alias("y")).distinct(), "pairs")
    links = _linked(stars, percent)
    if not pairs.isEmpty():
        links = links.unionByName(_linked(saved(_verified(pairs, rows, prefixes, percent), "rest"), percent))
    groups = _components(links)

    out = named.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"), "n_copies")
    none = found.filter("size = 0 or doc_id is null").select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_copies"))
    return out.unionByName(none)


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, all columns unchanged; rows without an id stay."""
    groups = similar_groups(docs, n, percent, text, doc_id)
    return without(docs, doc_id, groups.filter("doc_id <> component_id").select("doc_id"))
