"""Nearest-centroid join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import block, squared_distances, values
from shoal.session import BROADCAST_BYTES

STRIP_BYTES = 64 * 1024 * 1024
_SCHEMA = "id long, cluster_id int, dist double"


def nearest(vectors: DataFrame, centroids: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, cluster_id, dist): the closest centroid of every vector; ties go to the lowest cluster id.

    `vectors(id, vec)`, `centroids(cluster_id, vec)`. The centroids are measured before they are shipped to the
    executors; a larger set meets the vectors in a shuffle of vector tiles against centroid tiles instead.
    """
    size = centroids.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if size["n"] == 0:
        raise ValueError("no centroids")
    if size["n"] * size["d"] * 8 > limit_bytes:
        return _nearest_by_tiles(vectors, centroids, size["n"], rows_per_tile=max(1, limit_bytes // (8 * size["d"])))
    rows = centroids.select("cluster_id", "vec").orderBy("cluster_id").collect()
    ids = np.array([r["cluster_id"] for r in rows], dtype=np.int32)
    return nearest_to_matrix(vectors, ids, np.array([r["vec"] for r in rows], dtype=np.float64))


def nearest_to_matrix(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """`nearest` for centroids already on the driver, sorted by id."""
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster_ids, centres = shipped.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = block(batch.column("vec"))
            best, dist = _argmin(x, centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster_ids[best]), pa.array(dist)], names=["id", "cluster_id", "dist"]
            )

    return vectors.select(F.col("id").cast("long"), "vec").mapInArrow(assign, _SCHEMA)


def nearest_all(vectors: DataFrame, tables: dict[int, np.ndarray], limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, k, cluster_id, dist): the nearest row of every table `tables[k]`, all tables in one scan as far as they fit `limit_bytes` together."""
    spark, groups, held, out = vectors.sparkSession, [[]], 0, []
    for k, matrix in sorted(tables.items()):
        if matrix.nbytes > limit_bytes:
            centroids = spark.createDataFrame(list(enumerate(matrix.tolist())), "cluster_id int, vec array<double>")
            out.append(nearest(vectors, centroids, limit_bytes).select("id", F.lit(k).alias("k"), "cluster_id", "dist"))
            continue
        if groups[-1] and held + matrix.nbytes > limit_bytes:
            groups.append([])
            held = 0
        groups[-1].append(k)
        held += matrix.nbytes
    for group in filter(None, groups):
        shipped = spark.sparkContext.broadcast({k: tables[k] for k in group})

        def assign(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x = block(batch.column("vec"))
                for k, centres in shipped.value.items():
                    best, dist = _argmin(x, centres)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(np.full(len(x), k, np.int32)), pa.array(best.astype(np.int32)), pa.array(dist)],
                        names=["id", "k", "cluster_id", "dist"])

        out.append(vectors.select(F.col("id").cast("long"), "vec").mapInArrow(assign, "id long, k int, cluster_id int, dist double"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def _argmin(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.empty(len(x), dtype=np.int64)
    strip = max(1, STRIP_BYTES // (8 * max(len(centres), 1)))
    for start in range(0, len(x), strip):
        best[start:start + strip] = squared_distances(x[start:start + strip], centres).argmin(axis=1)
    diff = x - centres[best]
    return best, np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _nearest_by_tiles(vectors: DataFrame, centroids: DataFrame, n_centroids: int, rows_per_tile: int) -> DataFrame:
    centroid_tiles = -(-n_centroids // rows_per_tile)
    rows = vectors.count()
    vector_tiles = max(1, -(-rows // rows_per_tile))
    side = F.lit(0).alias("side")
    left = vectors.select(
        F.col("id").cast("long").alias("id"), "vec", side,
        F.pmod(F.xxhash64("id"), F.lit(vector_tiles)).alias("vt"),
        F.explode(F.sequence(F.lit(0), F.lit(centroid_tiles - 1))).alias("ct"),
    )
    right = centroids.select(
        F.col("cluster_id").cast("long").alias("id"), "vec", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.lit(vector_tiles - 1))).cast("long").alias("vt"),
        F.pmod(F.xxhash64("cluster_id"), F.lit(centroid_tiles)).cast("int").alias("ct"),
    )

    def assign(table: pa.Table) -> pa.Table:
        side_of = values(table.column("side"))
        ids, x = values(table.column("id")), block(table.column("vec"))
        points, centres = side_of == 0, np.flatnonzero(side_of == 1)
        centres = centres[np.argsort(ids[centres])]
        if not points.any() or len(centres) == 0:
            return pa.table({"id": pa.array([], pa.int64()), "cluster_id": pa.array([], pa.int32()),
                             "dist": pa.array([], pa.float64())})
        best, dist = _argmin(x[points], x[centres])
        return pa.table({"id": ids[points], "cluster_id": ids[centres][best].astype(np.int32), "dist": dist})

    per_tile = left.unionByName(right).groupBy("vt", "ct").applyInArrow(assign, _SCHEMA)
    winner = F.min(F.struct("dist", "cluster_id")).alias("w")
    return per_tile.groupBy("id").agg(winner).select("id", "w.cluster_id", "w.dist")
