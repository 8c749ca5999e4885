"""Per-cluster sums for many labelings of the same vectors in one pass.

A labeling is one (k, variant). Rows carry all their labels as a list next to one copy of the vector, so the
vectors are never multiplied by the number of labelings on their way through a shuffle; each task adds its rows
up per (labeling, cluster) and only those partial sums move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import block, list_column, values
from shoal.session import BROADCAST_BYTES

_SUM_SCHEMA = "lab int, cluster_id int, n long, vec array<double>"
_SPREAD_SCHEMA = "lab int, cluster_id int, n long, sum_dist double, sum_sq double, sum_cos double"


@dataclass
class Labelled:
    """Vectors with their labels: `rows(id, vec, labs array<struct<lab, cluster_id>>)`."""

    rows: DataFrame
    labelings: list[tuple[int, str]]
    expected: int | None = None

    def check(self, counted: dict[int, int]) -> None:
        """Fail if the rows counted for some labeling are not those expected of all."""
        wrong = [self.labelings[lab] for lab in range(len(self.labelings)) if self.expected is not None and counted.get(lab, 0) != self.expected]
        if wrong:
            raise ValueError(f"vectors and labels do not hold the same ids, see {wrong[:3]}")

    def labeling_table(self) -> DataFrame:
        spark = self.rows.sparkSession
        data = [(i, k, v) for i, (k, v) in enumerate(self.labelings)]
        return spark.createDataFrame(data, "lab int, k int, variant string")


def with_labels(vectors: DataFrame, assignments: DataFrame) -> Labelled:
    """Join `vectors(id, vec)` with `assignments(question_id, k, variant, cluster_id)`.

    Metrics of a part would pass for those of the whole, so vectors and labels must hold the same ids: as many of each, which is counted
    here, and all of them in the join, which is counted where clusters are (`Labelled.check`). So the join itself can be an inner one.
    """
    spark = vectors.sparkSession
    found = assignments.groupBy("k", "variant").agg(F.count("*").alias("n")).collect()
    labelings = sorted((r["k"], r["variant"]) for r in found)
    if not labelings:
        raise ValueError("no labelings")
    rows = vectors.count()
    wrong = sorted((r["k"], r["variant"]) for r in found if r["n"] != rows)
    if wrong:
        raise ValueError(f"vectors and labels do not hold the same ids, see {wrong[:3]}")
    index = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labelings)], "lab int, k int, variant string")
    per_id = (
        assignments.join(F.broadcast(index), ["k", "variant"])
        .groupBy(F.col("question_id").alias("id"))
        .agg(F.collect_list(F.struct("lab", F.col("cluster_id").cast("int").alias("cluster_id"))).alias("labs"))
    )
    joined = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).join(per_id, "id")
    return Labelled(joined, labelings, rows)


def _per_labeling(batch: pa.RecordBatch):
    """Yield (lab, row positions, cluster ids) for every labeling present in a batch."""
    labs = batch.column("labs")
    lengths = np.diff(labs.offsets.to_numpy())
    flat = labs.flatten()
    rows = np.repeat(np.arange(batch.num_rows), lengths)
    lab, cluster = values(flat.field("lab")), values(flat.field("cluster_id"))
    order = np.argsort(lab, kind="stable")
    bounds = np.flatnonzero(np.diff(lab[order])) + 1
    for part in np.split(order, bounds):
        if len(part):
            yield int(lab[part[0]]), rows[part], cluster[part]


class _Accumulator:
    """Rows of float sums by (labeling, cluster); grows by doubling."""

    def __init__(self, width: int):
        self.width, self.index, self.sums = width, {}, np.zeros((64, width))

    def add(self, lab: int, clusters: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(clusters, kind="stable")
        found, starts = np.unique(clusters[order], return_index=True)
        at = np.array([self.index.setdefault((lab, int(c)), len(self.index)) for c in found])
        while len(self.index) > len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
        self.sums[at] += np.add.reduceat(rows[order], starts, axis=0)

    def full(self) -> bool:
        return self.sums.nbytes > BROADCAST_BYTES

    def drain(self):
        keys, sums = list(self.index), self.sums[:len(self.index)]
        self.index, self.sums = {}, np.zeros((64, self.width))
        labs = pa.array([k[0] for k in keys], pa.int32())
        clusters = pa.array([k[1] for k in keys], pa.int32())
        return labs, clusters, sums


def centroids(labelled: Labelled) -> DataFrame:
    """(lab, cluster_id, n, vec): size and mean vector of every cluster of every labeling."""

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None

        def emit():
            labs, clusters, sums = acc.drain()
            return pa.RecordBatch.from_arrays(
                [labs, clusters, pa.array(sums[:, 0].astype(np.int64)), list_column(sums[:, 1:])],
                names=["lab", "cluster_id", "n", "vec"],
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = block(batch.column("vec"))
            x = np.hstack([np.ones((len(x), 1)), x])
            acc = acc or _Accumulator(x.shape[1])
            for lab, rows, clusters in _per_labeling(batch):
                acc.add(lab, clusters, x[rows])
                if acc.full():
                    yield emit()
        if acc is not None and acc.index:
            yield emit()

    partial = labelled.rows.select("vec", "labs").mapInArrow(partial_sums, _SUM_SCHEMA)
    total = F.sum("n").alias("n")
    sums = partial.groupBy("lab", "cluster_id").agg(
        total, vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("_sum")
    )
    mean = F.transform("_sum", lambda x: x / F.col("n")).alias("vec")
    return sums.select("lab", "cluster_id", "n", mean)


def spreads(labelled: Labelled, means: DataFrame, sizes: dict[int, int], limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lab, cluster_id, n, sum_dist, sum_sq, sum_cos) of the rows against their own centroid.

    `means` is the materialised table of `centroids` and `sizes` its bytes per labeling. It is shipped in groups of
    labelings that fit `limit_bytes`; a single labeling beyond that joins its centroids by key.
    """
    chunks, current, held, parts = [], [], 0, []
    for lab, cost in sorted(sizes.items()):
        if cost > limit_bytes:
            parts.append(_spread_by_join(labelled, lab, means))
            continue
        if current and held + cost > limit_bytes:
            chunks.append(current)
            current, held = [], 0
        current.append(lab)
        held += cost
    if current:
        chunks.append(current)
    parts += [_spread_by_broadcast(labelled, means.filter(F.col("lab").isin(chunk))) for chunk in chunks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("n", "sum_dist", "sum_sq", "sum_cos")]
    return out.groupBy("lab", "cluster_id").agg(*sums)


def _against(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Columns (1, distance, squared distance, cosine) of rows against paired centroids."""
    diff = x - m
    sq = np.einsum("ij,ij->i", diff, diff)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", m, m))
    dots = np.einsum("ij,ij->i", x, m)
    cos = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return np.column_stack([np.ones(len(x)), np.sqrt(sq), sq, cos])


def _spread_by_broadcast(labelled: Labelled, means: DataFrame) -> DataFrame:
    table = means.select("lab", "cluster_id", "vec").toArrow()
    labs, ids, matrix = values(table.column("lab")), values(table.column("cluster_id")), block(table.column("vec"))
    tables = {}
    for lab in np.unique(labs):
        mine = np.flatnonzero(labs == lab)
        mine = mine[np.argsort(ids[mine])]
        tables[int(lab)] = (ids[mine], matrix[mine])
    shipped = labelled.rows.sparkSession.sparkContext.broadcast(tables)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator(4)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = block(batch.column("vec"))
            for lab, rows, clusters in _per_labeling(batch):
                if lab not in shipped.value:
                    continue
                ids, means = shipped.value[lab]
                acc.add(lab, clusters, _against(x[rows], means[np.searchsorted(ids, clusters)]))
        if acc.index:
            labs, clusters, sums = acc.drain()
            yield pa.RecordBatch.from_arrays(
                [labs, clusters, pa.array(sums[:, 0].astype(np.int64)), *[pa.array(sums[:, i]) for i in (1, 2, 3)]],
                names=["lab", "cluster_id", "n", "sum_dist", "sum_sq", "sum_cos"],
            )

    return labelled.rows.select("vec", "labs").mapInArrow(partial, _SPREAD_SCHEMA)


def _spread_by_join(labelled: Labelled, lab: int, means: DataFrame, salts: int = 32) -> DataFrame:
    """The same sums for a centroid table too large to ship; a hot cluster is split over `salts` keys."""
    means = means.filter(F.col("lab") == lab).select("cluster_id", F.col("vec").alias("mean"))
    means = means.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = labelled.rows.select("id", "vec", F.inline("labs")).filter(F.col("lab") == lab)
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = mine.join(means.hint("merge"), ["cluster_id", "salt"]).select("lab", "cluster_id", "vec", "mean")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s = _against(block(batch.column("vec")), block(batch.column("mean")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lab"), batch.column("cluster_id"), pa.array(s[:, 0].astype(np.int64)),
                 *[pa.array(s[:, i]) for i in (1, 2, 3)]],
                names=["lab", "cluster_id", "n", "sum_dist", "sum_sq", "sum_cos"],
            )

    return joined.mapInArrow(partial, _SPREAD_SCHEMA)
