"""Nine cluster-quality metrics for any number of labelings in one sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import block, squared_distances, values
from shoal.operators.centroids import Labelled, _per_labeling, centroids, spreads, with_labels
from shoal.operators.pairs import STRIP_ROWS, TILE_ROWS, split_tiles, tile_pairs, within_group_distances
from shoal.operators.sampling import sample_ids
from shoal.session import BROADCAST_BYTES, BROADCAST_ROWS, checkpoint

METRICS = [
    "silhouette", "dbi", "chi", "dunn", "cohesion", "separation", "cosine_intra", "cosine_inter", "singleton_ratio",
]

# Direction of each metric, fixed values of the comparison report.
HIGHER_IS_BETTER = {
    "silhouette": True,
    "dbi": False,
    "chi": True,
    "dunn": True,
    "cohesion": False,
    "separation": True,
    "cosine_intra": True,
    "cosine_inter": False,
    "singleton_ratio": False,
}

SILHOUETTE_SAMPLE = 3000
# Of the silhouette of all rows: rows of a tile, bytes of its sums, clusters up to which distances are added by a matrix product.
SILHOUETTE_ROWS = 4096
SILHOUETTE_BYTES = 64 * 1024 * 1024
SILHOUETTE_COLUMNS = 256


class Evaluation:
    """Shared intermediate tables of a sweep, each built once on first use."""

    def __init__(self, vectors: DataFrame, assignments: DataFrame, tile_rows: int = TILE_ROWS,
                 limit_bytes: int = BROADCAST_BYTES):
        self._start(with_labels(vectors, assignments), tile_rows, limit_bytes)

    @classmethod
    def of(cls, labelled: Labelled, tile_rows: int = TILE_ROWS, limit_bytes: int = BROADCAST_BYTES) -> "Evaluation":
        """Evaluation of rows that already carry their labels."""
        out = cls.__new__(cls)
        out._start(labelled, tile_rows, limit_bytes)
        return out

    def _start(self, labelled: Labelled, tile_rows: int, limit_bytes: int) -> None:
        self.labelled, self.tile_rows, self.limit_bytes = labelled, tile_rows, limit_bytes
        self._means = self._sizes = self._stats = None

    @property
    def means(self) -> DataFrame:
        """(lab, cluster_id, n, vec), one row per cluster and labeling."""
        if self._means is None:
            self._means = checkpoint(centroids(self.labelled))
        return self._means

    @property
    def sizes(self) -> dict:
        """Per labeling: number of clusters, rows and bytes of the centroid table."""
        if self._sizes is None:
            totals = self.means.groupBy("lab").agg(
                F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.max(F.size("vec")).alias("d"))
            self._sizes = {
                r["lab"]: (r["clusters"], r["rows"], r["clusters"] * r["d"] * 8) for r in totals.collect()
            }
            self.labelled.check({lab: rows for lab, (_, rows, _) in self._sizes.items()})
        return self._sizes

    @property
    def stats(self) -> DataFrame:
        """`means` with the distance and cosine sums of the rows around each centroid."""
        if self._stats is None:
            cost = {lab: size for lab, (_, _, size) in self.sizes.items()}
            spread = spreads(self.labelled, self.means, cost, self.limit_bytes).drop("n")
            self._stats = checkpoint(self.means.join(spread, ["lab", "cluster_id"]))
        return self._stats

    def check_cluster_counts(self) -> None:
        """Silhouette, DBI and CHI exist only for 2 <= clusters <= rows - 1."""
        bad = [lab for lab, (clusters, rows, _) in self.sizes.items() if clusters < 2 or clusters > rows - 1]
        if bad:
            names = [self.labelled.labelings[lab] for lab in bad]
            raise ValueError(f"need 2 <= number of clusters <= rows - 1, not so for {names}")

    # -- centroid level ---------------------------------------------------------------------------------------

    def between(self) -> DataFrame:
        """(lab, dbi, separation, min_dist_multi) from all ordered centroid pairs of each labeling.

        The centroids of a labeling are tiled like any other group, so the pair work is spread over tasks.
        """
        cols = self.stats.select("lab", "cluster_id", "n", "vec", (F.col("sum_dist") / F.col("n")).alias("spread"))
        counts = [(lab, clusters) for lab, (clusters, _, _) in self.sizes.items()]
        counts = self.means.sparkSession.createDataFrame(counts, "lab int, n long")
        per_centroid = (
            tile_pairs(cols, ["lab"], ["cluster_id"], self.tile_rows, counts)
            .groupBy("lab", "ta", "tb").applyInArrow(_centroid_pairs, _CENTROID_SCHEMA)
            .groupBy("lab", "cluster_id")
            .agg(F.max("ratio").alias("ratio"), F.sum("dist_sum").alias("dist_sum"),
                 F.min("min_dist_multi").alias("min_dist_multi"), F.max("max_dist").alias("max_dist"),
                 F.max("spread").alias("spread"))
        )
        # All spreads or all centroid distances near zero: the index is 0, by definition.
        flat = (F.max("spread") <= 1e-8) | (F.max("max_dist") <= 1e-8)
        clusters = F.count("*")
        return per_centroid.groupBy("lab").agg(
            F.when(flat, F.lit(0.0)).otherwise(F.avg("ratio")).alias("dbi"),
            F.when(clusters >= 2, F.sum("dist_sum") / (clusters * (clusters - 1)))
            .otherwise(F.lit(float("nan"))).alias("separation"),
            F.min("min_dist_multi").alias("min_dist_multi"),
        )

    def dbi(self) -> DataFrame:
        self.check_cluster_counts()
        return self.between().select("lab", "dbi")

    def separation(self) -> DataFrame:
        return self.between().select("lab", "separation")

    def chi(self) -> DataFrame:
        """Between-cluster over within-cluster dispersion, each by its degrees of freedom."""
        self.check_cluster_counts()
        dims = self.means.select("lab", "n", F.posexplode("vec").alias("dim", "x"))
        per_dim = dims.groupBy("lab", "dim").agg(
            F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"),
            F.sum("n").alias("n"),
        )
        total = per_dim.groupBy("lab").agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("between"))
        within = self.stats.groupBy("lab").agg(
            F.sum("sum_sq").alias("within"), F.count("*").alias("clusters"), F.sum("n").alias("rows")
        )
        ratio = (F.col("between") * (F.col("rows") - F.col("clusters"))) / (F.col("within") * (F.col("clusters") - 1))
        return total.join(within, "lab").select(
            "lab", F.when(F.col("within") == 0, F.lit(1.0)).otherwise(ratio).alias("chi")
        )

    def cosine_intra(self) -> DataFrame:
        return self.stats.groupBy("lab").agg((F.sum("sum_cos") / F.sum("n")).alias("cosine_intra"))

    def cosine_inter(self) -> DataFrame:
        """Mean cosine over ordered centroid pairs from the sum of unit centroids, without forming pairs."""
        _ = self.sizes  # checks the ids
        sq = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        unit = self.means.withColumn("_n", F.sqrt(sq)).select(
            "lab", F.posexplode(F.transform("vec", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)))
            .alias("dim", "u"),
        )
        per_dim = unit.groupBy("lab", "dim").agg(
            F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("clusters")
        )
        value = F.sum(F.col("s") * F.col("s") - F.col("q")) / (F.max("clusters") * (F.max("clusters") - 1))
        return per_dim.groupBy("lab").agg(
            F.when(F.max("clusters") >= 2, value).otherwise(F.lit(float("nan"))).alias("cosine_inter")
        )

    def singleton_ratio(self) -> DataFrame:
        _ = self.sizes  # checks the ids
        ones = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
        return self.means.groupBy("lab").agg((ones / F.count("*")).alias("singleton_ratio"))

    # -- pair level -------------------------------------------------------------------------------------------

    def within_pairs(self) -> DataFrame:
        """(lab, cluster_id, n, pair_sum, pair_max) for clusters of more than one row."""
        exploded = self.labelled.rows.select("id", "vec", F.inline("labs"))
        sums = within_group_distances(exploded, ["lab", "cluster_id"], self.tile_rows, self.means)
        return self.means.filter("n > 1").select("lab", "cluster_id", "n").join(sums, ["lab", "cluster_id"])

    def pair_metrics(self) -> DataFrame:
        """(lab, dbi, separation, cohesion, dunn).

        Cohesion pools all ordered pairs of all multi-row clusters; Dunn is nearest centroids over widest cluster.
        """
        per_lab = self.within_pairs().groupBy("lab").agg(
            (F.sum("pair_sum") / F.sum(F.col("n") * F.col("n"))).alias("cohesion"),
            F.max("pair_max").alias("widest"), F.count("*").alias("multi"),
        )
        nan = F.lit(float("nan"))
        valid = (F.col("multi") >= 2) & (F.col("widest") > 0)
        return self.between().join(per_lab, "lab", "left").select(
            "lab", "dbi", "separation", F.coalesce("cohesion", nan).alias("cohesion"),
            F.when(valid, F.col("min_dist_multi") / F.col("widest")).otherwise(nan).alias("dunn"),
        )

    def cohesion(self) -> DataFrame:
        return self.pair_metrics().select("lab", "cohesion")

    def dunn(self) -> DataFrame:
        return self.pair_metrics().select("lab", "dunn")

    def silhouette(self, sample_size: int | None = SILHOUETTE_SAMPLE, seed=42, metric: str = "euclidean") -> DataFrame:
        """(lab, silhouette) inside one sample, or of all rows for a `sample_size` of None."""
        self.check_cluster_counts()
        if sample_size is None:
            return whole_silhouette(self.labelled, self.means, metric)
        return sampled_silhouette(self.labelled, sample_size, seed, metric)

    # -- all --------------------------------------------------------------------------------------------------

    def table(self, sample_size: int | None = SILHOUETTE_SAMPLE, seed=42) -> DataFrame:
        """One row per labeling with the nine metrics, `k` and `variant`."""
        out = self.labelled.labeling_table()
        for part in (self.silhouette(sample_size, seed), self.chi(), self.pair_metrics(), self.cosine_intra(),
                     self.cosine_inter(), self.singleton_ratio()):
            out = out.join(part, "lab", "left")
        return out.select(*METRICS, "k", "variant")

    def named(self, per_lab: DataFrame) -> DataFrame:
        """Replace the labeling index by (k, variant)."""
        return self.labelled.labeling_table().join(per_lab, "lab").drop("lab")


_CENTROID_SCHEMA = (
    "lab int, cluster_id int, ratio double, dist_sum double, min_dist_multi double, max_dist double, spread double"
)

_EMPTY_SIDE = {"cluster_id": np.int32, "ratio": float, "dist_sum": float, "min_dist_multi": float,
               "max_dist": float, "spread": float}


def _centroid_pairs(table: pa.Table) -> pa.Table:
    """Per centroid of a tile pair: worst spread ratio, distance sum and nearest centroid of a multi-row cluster."""
    a, b, same = split_tiles(table)
    ids, x = values(table.column("cluster_id")), block(table.column("vec"))
    spread, multi = values(table.column("spread")), values(table.column("n")) > 1
    d2 = squared_distances(x[a], x[b])
    norms = np.einsum("ij,ij->i", x, x)
    # The product form loses digits for nearly equal centroids: take their differences instead.
    close = np.argwhere(d2 < 1e-6 * (norms[a][:, None] + norms[b][None, :]))
    for i, j in close:
        diff = x[a[i]] - x[b[j]]
        d2[i, j] = diff @ diff
    if same:
        np.fill_diagonal(d2, 0.0)
    dist = np.sqrt(d2)
    far = np.where(dist > 0, dist, np.inf)
    ratio = (spread[a][:, None] + spread[b][None, :]) / far
    both = multi[a][:, None] & multi[b][None, :]
    if same:
        np.fill_diagonal(both, False)
    between = np.where(both, dist, np.inf)

    def rows(axis: int, at: np.ndarray) -> dict:
        smallest = between.min(axis=axis)
        return {
            "cluster_id": ids[at], "ratio": ratio.max(axis=axis), "dist_sum": dist.sum(axis=axis),
            "min_dist_multi": np.where(np.isinf(smallest), np.nan, smallest), "max_dist": dist.max(axis=axis),
            "spread": spread[at],
        }

    if len(a) == 0 or len(b) == 0:
        sides = [{c: np.array([], t) for c, t in _EMPTY_SIDE.items()}]
    else:
        sides = [rows(1, a)] if same else [rows(1, a), rows(0, b)]
    cols = {c: np.concatenate([s[c] for s in sides]) for c in sides[0]}
    cols["min_dist_multi"] = pa.array(cols["min_dist_multi"], from_pandas=True)
    lab = np.full(len(cols["ratio"]), table.column("lab")[0].as_py(), dtype=np.int32)
    return pa.table({"lab": lab, **cols})


def sampled_silhouette(labelled: Labelled, sample_size: int, seed=42, metric: str = "euclidean") -> DataFrame:
    """(lab, silhouette): mean silhouette inside one sample of at most `sample_size` rows.

    The sample (bounded by `sample_size`) goes to every executor; its rows are spread over tasks, each measuring
    its rows against the whole sample once for all labelings.
    """
    spark = labelled.rows.sparkSession
    ids = sample_ids(labelled.rows, sample_size, seed)
    rows = labelled.rows.join(F.broadcast(ids) if sample_size <= BROADCAST_ROWS else ids, "id", "left_semi")
    table = rows.toArrow().combine_chunks()
    table = table.take(pa.array(np.argsort(values(table.column("id"))))).combine_chunks()
    n = table.num_rows
    x = block(table.column("vec"))
    if x.nbytes > BROADCAST_BYTES:
        raise ValueError(f"a silhouette sample of {x.nbytes} bytes is too large; choose a smaller sample_size")
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        x = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
    missing = np.iinfo(np.int64).min
    labels = np.full((len(labelled.labelings), n), missing, dtype=np.int64)
    for batch in table.to_batches():
        for lab, at, clusters in _per_labeling(batch):
            labels[lab, at] = clusters
    shipped = spark.sparkContext.broadcast((x, labels))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, names = shipped.value
        for batch in batches:
            at = values(batch.column("id"))
            for start in range(0, len(at), 512):
                mine = at[start:start + 512]
                if metric == "cosine":
                    dist = 1.0 - points[mine] @ points.T
                else:
                    dist = np.sqrt(squared_distances(points[mine], points))
                dist[np.arange(len(mine)), mine] = 0.0
                sums = [_silhouette_sum(dist, mine, row, missing) for row in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(names), dtype=np.int32)), pa.array([s[0] for s in sums], pa.float64()),
                     pa.array([s[1] for s in sums], pa.int64())], names=["lab", "total", "n"],
                )

    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 128)))
    partial = spark.range(0, n, 1, tasks).mapInArrow(measure, "lab int, total double, n long")
    return partial.groupBy("lab").agg((F.sum("total") / F.sum("n")).alias("silhouette"))


def whole_silhouette(labelled: Labelled, means: DataFrame, metric: str = "euclidean", tile_rows: int | None = None) -> DataFrame:
    """(lab, silhouette): mean silhouette over all rows; `means(lab, cluster_id, n)` has a row to each cluster.

    The work is quadratic. Rows are packed into tiles; a task holds one of them with its sums by cluster, and all tiles stream past it, read
    again and again where they are saved: they are shuffled once, pairs of rows never. Sums of a tile take SILHOUETTE_BYTES at most.
    """
    spark = labelled.rows.sparkSession
    table = means.select("lab", "cluster_id", "n").toArrow()  # a row to a cluster
    labs, clusters, sizes = (values(table.column(c)).astype(np.int64) for c in ("lab", "cluster_id", "n"))
    order = np.lexsort((clusters, labs))
    labs, clusters, sizes = labs[order], clusters[order], sizes[order]
    starts = np.searchsorted(labs, np.arange(len(labelled.labelings) + 1))
    n = int(sizes[:starts[1]].sum())
    if tile_rows is None:
        even = -(-n // (2 * spark.sparkContext.defaultParallelism))
        tile_rows = max(16, min(SILHOUETTE_ROWS, max(256, even), SILHOUETTE_BYTES // (8 * len(sizes))))
    tiles = -(-n // tile_rows)
    shipped = spark.sparkContext.broadcast((starts, clusters, sizes))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        starts, clusters, _ = shipped.value
        x = block(rows.column("vec"))
        if metric == "cosine":
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            x = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        codes = np.zeros((len(x), len(starts) - 1), np.int32)
        for lab, at, own in _per_labeling(rows.combine_chunks().to_batches()[0]):
            codes[at, lab] = starts[lab] + np.searchsorted(clusters[starts[lab]:starts[lab + 1]], own)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "rows": [len(x)], "vec": [x.tobytes()], "codes": [codes.tobytes()]})

    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile")
    packed = labelled.rows.select(tile, "vec", "labs").groupBy("tile").applyInArrow(pack, "tile int, rows long, vec binary, codes binary")
    packed = checkpoint(packed)
    queries = packed.select("tile", F.col("rows").alias("q_rows"), F.col("vec").alias("q_vec"), F.col("codes").alias("q_codes"))
    queries = queries.withColumnRenamed("tile", "q_tile").repartition(tiles)
    pairs = packed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(queries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, sizes = shipped.value
        held = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                name = row["q_tile"].as_py()
                if name not in held:
                    held[name] = (*_tile(row["q_rows"], row["q_vec"], row["q_codes"]), np.zeros((row["q_rows"].as_py(), len(sizes))))
                x, _, sums = held[name]
                y, codes = _tile(row["rows"], row["vec"], row["codes"])
                _add_distances(sums, x, y, codes, starts, metric, row["tile"].as_py() == name)
        for x, codes, sums in held.values():
            found = [_silhouettes(sums[:, a:b], sizes[a:b], codes[:, lab] - a) for lab, (a, b) in enumerate(zip(starts, starts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(found), dtype=np.int32)), pa.array([float(s.sum()) for s in found]), pa.array([len(x)] * len(found))],
                names=["lab", "total", "n"])

    partial = pairs.mapInArrow(measure, "lab int, total double, n long")
    return partial.groupBy("lab").agg((F.sum("total") / F.sum("n")).alias("silhouette"))


def _tile(rows, vec, codes) -> tuple[np.ndarray, np.ndarray]:
    n = rows.as_py()
    return np.frombuffer(vec.as_buffer()).reshape(n, -1), np.frombuffer(codes.as_buffer(), np.int32).reshape(n, -1)


def _add_distances(sums: np.ndarray, x: np.ndarray, y: np.ndarray, codes: np.ndarray, starts: np.ndarray, metric: str, same: bool) -> None:
    """Add the distances of the rows x to the rows y, by the clusters of y in every labeling."""
    if few := sums.shape[1] <= SILHOUETTE_COLUMNS:
        member = np.zeros((len(y), sums.shape[1]))
        for own in codes.T:
            member[np.arange(len(y)), own] = 1.0
    else:
        orders = [np.argsort(own, kind="stable") for own in codes.T]
        runs = [np.flatnonzero(np.diff(own[o], prepend=-1)) for own, o in zip(codes.T, orders)]
    for start in range(0, len(x), STRIP_ROWS):
        strip = x[start:start + STRIP_ROWS]
        dist = 1.0 - strip @ y.T if metric == "cosine" else np.sqrt(squared_distances(strip, y))
        if same:
            at = np.arange(len(strip))
            dist[at, start + at] = 0.0
        out = sums[start:start + STRIP_ROWS]
        if few:
            out += dist @ member
        else:
            for own, o, first in zip(codes.T, orders, runs):
                out[:, own[o[first]]] += np.add.reduceat(dist[:, o], first, axis=1)


def _silhouettes(sums: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row, from its sums of distances by cluster."""
    if len(sizes) < 2:
        return np.full(len(own), np.nan)
    at = np.arange(len(own))
    inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    others = sums / sizes[None, :]
    others[at, own] = np.inf
    outside = others.min(axis=1)
    scale = np.maximum(inside, outside)
    s = np.divide(outside - inside, scale, out=np.zeros_like(scale), where=scale > 0)
    s[sizes[own] == 1] = 0.0
    return s


def _silhouette_sum(dist: np.ndarray, mine: np.ndarray, names: np.ndarray, missing: int) -> tuple[float, int]:
    used = np.flatnonzero(names != missing)
    found, index, counts = np.unique(names[used], return_inverse=True, return_counts=True)
    rows = np.flatnonzero(names[mine] != missing)
    if len(found) < 2:
        return float("nan"), len(rows)
    order = np.argsort(index, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sums = np.add.reduceat(dist[np.ix_(rows, used[order])], starts, axis=1)
    return float(_silhouettes(sums, counts, np.searchsorted(found, names[mine[rows]])).sum()), len(rows)


def evaluate(vectors: DataFrame, assignments: DataFrame, sample_size: int | None = SILHOUETTE_SAMPLE, seed=42) -> DataFrame:
    """The metric table of every labeling in `assignments`; the vectors are expected to be normalised. No `sample_size`: silhouettes of all rows.

    The labelled vectors are read four times, so they are kept for the duration of the call.
    """
    labelled = with_labels(vectors, assignments)
    labelled.rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return checkpoint(Evaluation.of(labelled).table(sample_size, seed))
    finally:
        labelled.rows.unpersist()


def main_only(metrics: DataFrame) -> DataFrame:
    """The rows of the k-means labelings alone."""
    return metrics.filter(F.col("variant") == "kmeans")
