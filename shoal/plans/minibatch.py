"""Mini-batch k-means: centres move by small batches of rows, each with its own learning rate.

Rows stand in md5 order of their ids, which is a random order that does not depend on partitioning, and are written in that order, cut into
folders of some batches each; a step reads its batch alone. The rows of a batch are added up by centre on the executors, the driver holds the
centres. A centre's rate is one over the rows it has taken so far, so after a step it is the mean of all of them. Batches go round the table until
the smoothed cost of a batch has not become lower by a share of TOLERANCE for `patience` steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.hashing import digest
from shoal.functions.vectors import block, list_column, squared_distances, values
from shoal.operators.ordering import with_row_number
from shoal.plans.baselines import seed_centres
from shoal.session import discard, scratch_path

BATCH_ROWS = 4096
FOLDER_BATCHES = 64
PATIENCE = 10
MAX_EPOCHS = 100
TOLERANCE = 1e-3
SEED = 42


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per centre, the rows nearest to it: their number, sum and squared distances."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = block(batch.column("vec"))
        dist = squared_distances(x, centres)
        label = dist.argmin(axis=1)
        order = np.argsort(label, kind="stable")
        found, starts = np.unique(label[order], return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(np.diff(np.append(starts, len(order)))), list_column(np.add.reduceat(x[order], starts, axis=0)),
             pa.array(np.add.reduceat(dist[order, label[order]], starts))], names=["cluster", "n", "vec", "cost"])


def minibatch_fit(vectors: DataFrame, k: int, batch_rows: int = BATCH_ROWS, seed: int = SEED, patience: int = PATIENCE,
                  max_epochs: int = MAX_EPOCHS, starts: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Centres and the number of steps taken. `starts` are the first centres; by default k-means++ rows of the whole table."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    centres = np.array(seed_centres(plain, k, seed)[1] if starts is None else starts, np.float64)
    numbered = with_row_number(plain.withColumn("_d", digest(F.col("id"), seed)), ["_d", "id"])
    path = scratch_path(spark, "batches")
    batch = F.floor((F.col("rn") - 1) / batch_rows)
    placed = numbered.select("vec", batch.alias("batch"), F.floor(batch / FOLDER_BATCHES).alias("folder"))
    placed.write.partitionBy("folder").parquet(path)
    rows = spark.read.schema("vec array<double>, batch long, folder long").parquet(path)
    total = rows.count()
    n_batches = -(-total // batch_rows)
    taken = np.zeros(k)
    rate = min(1.0, 2.0 * batch_rows / (total + 1))
    smooth, best, waited, step = None, None, 0, 0
    while step < max_epochs * n_batches and waited < patience:
        at = step % n_batches
        shipped = spark.sparkContext.broadcast(centres)
        mine = rows.filter((F.col("folder") == at // FOLDER_BATCHES) & (F.col("batch") == at)).select("vec")
        sums = mine.mapInArrow(lambda b, s=shipped: _sums(b, s.value), "cluster int, n long, vec array<double>, cost double").groupBy("cluster").agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"), F.sum("cost").alias("cost")).toArrow()  # k rows
        shipped.unpersist()
        cluster, n = values(sums.column("cluster")), values(sums.column("n")).astype(float)
        centres = centres.copy()
        centres[cluster] = (centres[cluster] * taken[cluster][:, None] + block(sums.column("vec"))) / (taken[cluster] + n)[:, None]
        taken[cluster] += n
        cost = float(values(sums.column("cost")).sum()) / n.sum()
        smooth = cost if smooth is None else smooth * (1.0 - rate) + cost * rate
        waited = 0 if best is None or smooth < best * (1.0 - TOLERANCE) else waited + 1
        best = smooth if waited == 0 else best
        step += 1
    discard(spark, path)
    return centres, step
