"""Candidates for deduplication: rows of like vectors, as classes instead of a list of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.components import connected_components
from shoal.operators.proximity import TILE_ROWS, Block, build_tree, distances, distinct_points, metric_space, search, to_euclidean
from shoal.plans.density import FOREST, FOREST_TILES, Forest, _spanning
from shoal.session import checkpoint

MIN_COSINE = 0.9


class Links(Forest):
    """Links of a group with the tiles it meets: a spanning forest of them, and how many each row has.

    Only rows of one cluster are linked (column `cluster`). A result row is a link (m = 0) or a row's count of links in v (m = -1).
    """

    def __init__(self, queries: Block, eps: float):
        super().__init__(queries, "cosine", [eps], 1)
        self.counts = np.zeros(len(queries.ids), np.int64)

    def meet(self, tile: Block) -> None:
        near = self.q.near(tile, self.q.reach)
        if len(near) == 0:
            return
        theirs = self._places(tile.ids)  # first, as it may move the others
        mine = self._places(self.q.ids)
        weight = tile.carried["weight"].astype(np.float64)
        none = np.zeros(len(tile.ids))
        for start in range(0, len(near), 1024):
            rows = near[start:start + 1024]
            dist = distances(self.q, rows, tile, "cosine")
            dist[self.q.carried["cluster"][rows][:, None] != tile.carried["cluster"][None, :]] = np.inf
            self.counts[rows] += ((dist <= self.eps[0]) @ weight).astype(np.int64)
            first = self.q.tile[rows] <= tile.tile[0]  # a pair of tiles is linked once
            if first.any():
                self._join(0, dist[first], mine[rows[first]], theirs, np.zeros(int(first.sum())), none)

    def result(self) -> pa.Table:
        links = []
        for m, a, b, level, weight in self.found():
            kept = _spanning(len(self.ids), level, a, b)
            links.append((m, level[kept], a[kept], b[kept], weight[kept]))
        n = len(self.counts)
        counts = {"m": np.full(n, -1, np.int32), "level": np.zeros(n, np.int32), "u": self.q.ids, "v": self.counts, "weight": np.zeros(n)}
        return pa.concat_tables([self.table(links), pa.table(counts)])


def linked(vectors: DataFrame, labels: DataFrame | None = None, min_cosine: float = MIN_COSINE,
           tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Links between rows whose vectors have a cosine of at least `min_cosine`, as membership and as pairs of representatives.

    Membership is (question_id, rep, component_id, links): the lowest id among equal vectors, the lowest id that links lead to, and the
    number of other rows linked with this one, copies included. Pairs are (id_a, id_b, cosine) of representatives, a spanning forest
    of each component (more links than that may be listed where tasks found the same component, all of them true ones). With `labels(question_id,
    cluster_id)` only rows of one cluster are linked. A zero vector is alike to none; equal vectors are linked whatever their number.
    """
    if not 0.0 < min_cosine <= 1.0:
        raise ValueError("the least cosine must be above 0 and at most 1")
    cluster = F.lit(0).cast("long").alias("cluster")
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec", cluster)
    if labels is not None:
        rows = rows.drop("cluster").join(labels.select(F.col("question_id").alias("id"), F.col("cluster_id").cast("long").alias("cluster")), "id")
    rows = checkpoint(rows)
    unit = metric_space(rows, "cosine").join(rows.select("id", "cluster"), "id")
    points, copies = distinct_points(unit, ["cluster"])
    points = checkpoint(points)
    eps = 1.0 - min_cosine
    tree = build_tree(points.drop("cluster"), tile_rows)
    placed = tree.rows.join(points.select("id", "cluster"), "id").withColumn("reach", F.lit(to_euclidean(eps, "cosine")))
    found = checkpoint(search(tree, placed, ["weight", "cluster"], lambda q: Links(q, eps), FOREST, FOREST_TILES))
    links = found.filter("m = 0")
    counts = found.filter("m = -1").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("n"))
    roots = connected_components(links.select(F.lit(0).alias("g"), "u", "v")).select(F.col("id").alias("rep"), "root")
    members = copies.join(counts, "rep").join(roots, "rep", "left").select(
        F.col("id").alias("question_id"), "rep", F.coalesce("root", "rep").alias("component_id"), (F.col("n") - 1).alias("links"))
    alone = rows.join(copies.select("id"), "id", "left_anti").select(
        F.col("id").alias("question_id"), F.col("id").alias("rep"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    pairs = links.select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"), (1 - F.col("weight")).alias("cosine")).dropDuplicates(["id_a", "id_b"])
    return members.unionByName(alone), pairs


def dedup_candidates(vectors: DataFrame, labels: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(question_id, rep, component_id, links) of every row, see `linked`; rows that are not their component's id are the candidates."""
    return linked(vectors, labels, min_cosine)[0]
