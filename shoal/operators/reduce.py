"""Principal components: one fit at the largest size, smaller sizes are prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import block, list_column
from shoal.operators.sampling import sample


@dataclass
class Components:
    """Mean, loadings (input dims x k, each column's largest entry positive) and variance shares."""

    mean: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray

    def prefix(self, k: int) -> "Components":
        return Components(self.mean, self.loadings[:, :k], self.shares[:k])


def fit(vectors: DataFrame, k: int) -> Components:
    """Centre, then PCA. Spark adds up the d x d covariance on the executors; only that reaches the driver."""
    ml = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(ml)
    model = PCA(k=k, inputCol="centred", outputCol="pca").fit(scaler.transform(ml))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return Components(scaler.mean.toArray(), loadings * signs, model.explainedVariance.toArray())


def project(vectors: DataFrame, components: Components) -> DataFrame:
    """(id, vec): centred rows on the components."""
    shipped = vectors.sparkSession.sparkContext.broadcast((components.mean, components.loadings))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, loadings = shipped.value
        for batch in batches:
            if batch.num_rows:
                reduced = (block(batch.column("vec")) - mean) @ loadings
                yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(reduced)], names=["id", "vec"])

    return vectors.select(F.col("id").cast("long"), "vec").mapInArrow(apply, "id long, vec array<double>")


def reduce_to(vectors: DataFrame, sizes: list[int]) -> dict[int, DataFrame]:
    """A projected table per size from a single fit."""
    components = fit(vectors, max(sizes))
    return {size: project(vectors, components.prefix(size)) for size in sizes}


def kept_variance(components: Components, sizes: list[int]) -> list[tuple[int, float]]:
    return [(size, float(components.shares[:size].sum())) for size in sizes]


def project_2d(vectors: DataFrame, assignments: DataFrame, n_sample: int = 20000, seed=42) -> DataFrame:
    """(id, x, y, cluster_id) of a sample on its first two components."""
    chosen = sample(vectors, n_sample, seed)
    flat = project(chosen, fit(chosen, 2)).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    labels = assignments.select(F.col("question_id").alias("id"), "cluster_id")
    return flat.join(labels, "id")
