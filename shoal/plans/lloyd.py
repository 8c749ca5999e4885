"""K-means for many K at once: Lloyd steps of all runs in one scan of the vectors.

Each row carries, for every run, its label, an upper bound of the distance to its own centre and a lower bound of that to any other.
When centres move, the bounds are moved by as much, and only rows whose bounds meet are measured against all centres again; so a step
costs little once most rows have settled. A scan adds up, per run and cluster, the rows that changed sides; only these sums leave a task, and the driver
holds the centres (bounded by the K asked for and measured), never rows. Bounds are written in the 1st, 2nd, 4th, 8th, ... scan, next to the
sums; in between they follow from the written ones and from how far each centre is from where it was then. So a step is one job over a
written table, and a lost executor costs its tasks alone.
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

from shoal.functions.vectors import block, list_column, packed_column, squared_distances, unpacked
from shoal.session import BROADCAST_BYTES, discard, scratch_path

MAX_ITER = 20
TOLERANCE = 1e-4
STRIP_BYTES = 64 * 1024 * 1024
_SLACK = 1e-6  # rounding of the matrix product; bounds this close are measured again
# Vectors and bounds are kept as bytes; a row's bounds are (label, upper, lower) of each run.
_SCHEMA = "kind int, id long, vec binary, bounds binary, sums array<double>, run int, cluster int, n long"
_RESULT = "id long, vec array<double>, labels array<int>, upper array<double>"


@dataclass
class Fit:
    centres: np.ndarray
    cost: float
    iterations: int
    settled: bool


@dataclass
class JointFit:
    """`rows(id, vec, labels, upper)`: labels in the order of `ks`, and the distances to the own centres; a table at `path`."""

    rows: DataFrame
    ks: list[int]
    fits: dict[int, Fit]
    path: str

    def discard(self) -> None:
        discard(self.rows.sparkSession, self.path)

    def assignments(self, ks: list[int] | None = None, variant: str = "kmeans") -> DataFrame:
        """(question_id, k, variant, cluster_id)"""
        one = [F.struct(F.lit(k).alias("k"), F.lit(variant).alias("variant"), F.col("labels")[i].alias("cluster_id"))
               for i, k in enumerate(self.ks) if ks is None or k in ks]
        return self.rows.select(F.col("id").alias("question_id"), F.inline(F.array(*one)))


@dataclass
class _Run:
    """What a scan needs to know of a run."""

    centres: np.ndarray
    moved: np.ndarray  # how far each centre is from where it was when the bounds were written
    half: np.ndarray  # half the distance from each centre to its nearest other one
    active: bool

    @classmethod
    def of(cls, centres: np.ndarray, before: np.ndarray, active: bool) -> "_Run":
        half = np.full(len(centres), np.inf)
        for start in range(0, len(centres), 1024):
            apart = squared_distances(centres[start:start + 1024], centres)
            apart[np.arange(len(apart)), start + np.arange(len(apart))] = np.inf
            half[start:start + 1024] = 0.5 * np.sqrt(apart.min(axis=1))
        return cls(centres, np.sqrt(((centres - before) ** 2).sum(axis=1)), half, active)

    def furthest_other(self, labels: np.ndarray) -> np.ndarray:
        """The most that any centre but a row's own has moved."""
        order = np.argsort(self.moved)
        second = self.moved[order[-2]] if len(order) > 1 else 0.0
        return np.where(labels == order[-1], second, self.moved[order[-1]])


def _measured(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label (ties to the lowest), distance to that centre, and the distance of the second nearest."""
    label, second = np.empty(len(x), np.int32), np.full(len(x), np.inf)
    strip = max(1, STRIP_BYTES // (8 * len(centres)))
    for start in range(0, len(x), strip):
        dist = squared_distances(x[start:start + strip], centres)
        best = dist.argmin(axis=1)
        label[start:start + strip] = best
        if len(centres) > 1:
            dist[np.arange(len(best)), best] = np.inf
            second[start:start + strip] = np.sqrt(dist.min(axis=1))
    return label, _own(x, centres, label), second


def _own(x: np.ndarray, centres: np.ndarray, labels: np.ndarray) -> np.ndarray:
    diff = x - centres[labels]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


class _Sums:
    """Sums of the rows that joined a cluster less those that left it."""

    def __init__(self, k: int, dims: int):
        self.total, self.n, self.touched = np.zeros((k, dims)), np.zeros(k, np.int64), np.zeros(k, bool)

    def add(self, x: np.ndarray, labels: np.ndarray, sign: int) -> None:
        at = np.flatnonzero(labels >= 0)
        if len(at) == 0:
            return
        at = at[np.argsort(labels[at], kind="stable")]
        found, starts = np.unique(labels[at], return_index=True)
        self.total[found] += sign * np.add.reduceat(x[at], starts, axis=0)
        self.n += sign * np.bincount(labels[at], minlength=len(self.n))
        self.touched[found] = True


def _bounded(batches: Iterator[pa.RecordBatch], runs: list[_Run], sums: list[_Sums], first: bool, every: bool, exact: bool):
    """(batch, x, bounds) with the bounds of the runs that are active (of `every` run) made anew, tight ones if `exact`; adds to `sums`."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        x = block(batch.column("vec")) if first else unpacked(batch.column("vec"), np.float64)
        bounds = np.full((n, len(runs), 3), -1.0) if first else unpacked(batch.column("bounds"), np.float64).reshape(n, len(runs), 3).copy()
        if not sums:
            sums += [_Sums(len(r.centres), x.shape[1]) for r in runs]
        for i, run in enumerate(runs):
            if not run.active and not every:
                continue
            old = bounds[:, i, 0].astype(np.int32)
            labels, upper, lower = old.copy(), bounds[:, i, 1], bounds[:, i, 2]
            if first:
                labels, upper[:], lower[:] = _measured(x, run.centres)
            else:
                upper += run.moved[old]
                lower -= run.furthest_other(old)
                bound = np.maximum(run.half[old], lower)
                todo = np.arange(n) if exact else np.flatnonzero(upper + _SLACK >= bound)
                upper[todo] = _own(x[todo], run.centres, old[todo])
                todo = todo[upper[todo] + _SLACK >= bound[todo]]
                if len(todo):
                    labels[todo], upper[todo], lower[todo] = _measured(x[todo], run.centres)
            bounds[:, i, 0] = labels
            changed = np.flatnonzero(labels != old)
            if len(changed):
                sums[i].add(x[changed], labels[changed], 1)
                sums[i].add(x[changed], old[changed], -1)
        yield batch, x, bounds


def _scan(batches: Iterator[pa.RecordBatch], runs: list[_Run], first: bool, write: bool) -> Iterator[pa.RecordBatch]:
    """Sums of the rows that are on another side than written, and, to `write`, the rows with their new bounds."""
    sums: list[_Sums] = []
    for batch, x, bounds in _bounded(batches, runs, sums, first, write, False):
        if write:
            n = len(x)
            none = [pa.nulls(n, t) for t in (pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column("id"), packed_column(x), packed_column(bounds.reshape(n, -1)), *none], names=_NAMES)
    for i, s in enumerate(sums):
        at = np.flatnonzero(s.touched)
        for start in range(0, len(at), 4096):
            part = at[start:start + 4096]
            n = len(part)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), *none, list_column(s.total[part]),
                 pa.array(np.full(n, i, np.int32)), pa.array(part.astype(np.int32)), pa.array(s.n[part])], names=_NAMES)


def _last(batches: Iterator[pa.RecordBatch], runs: list[_Run]) -> Iterator[pa.RecordBatch]:
    """The rows with their labels for the centres a run ended with, and the distances to them."""
    for batch, x, bounds in _bounded(batches, runs, [], False, True, True):
        labels = bounds[:, :, 0].astype(np.int32)
        offsets = pa.array(np.arange(0, (len(x) + 1) * len(runs), len(runs), dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), list_column(x), pa.ListArray.from_arrays(offsets, pa.array(labels.reshape(-1))), list_column(bounds[:, :, 1])],
            names=["id", "vec", "labels", "upper"])


_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def joint_fit(vectors: DataFrame, starts: dict[int, np.ndarray], max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> JointFit:
    """Lloyd's algorithm for every K from its `starts` (K x dims), as if each ran alone.

    A run stops once no centre moves by more than `tolerance`, or after `max_iter` steps; its labels are those of its last centres.
    A cluster that loses all rows keeps its centre. The centres of all runs must fit a broadcast; `groups_of` deals runs out that do not.
    """
    spark = vectors.sparkSession
    ks = sorted(starts)
    settled = [False] * len(ks)
    if sum(c.nbytes for c in starts.values()) > BROADCAST_BYTES:
        raise ValueError(f"the centres of {ks} are too large to go to every executor at once; fit them in groups")
    bases = [np.asarray(starts[k], np.float64) for k in ks]  # the centres when the bounds were written
    runs = [_Run.of(c, c, True) for c in bases]
    totals, counts = [np.zeros_like(c) for c in bases], [np.zeros(len(c), np.int64) for c in bases]
    state, path, steps = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), None, [0] * len(ks)

    def scanned(write: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums and sizes of all clusters for the centres of now."""
        nonlocal state, path, bases, totals, counts
        shipped, first = spark.sparkContext.broadcast(runs), path is None
        found = state.mapInArrow(lambda batches: _scan(batches, shipped.value, first, write), _SCHEMA)
        if write:
            out = scratch_path(spark, "lloyd")
            found.write.partitionBy("kind").parquet(out)
            if path is not None:
                discard(spark, path)
            path, found = out, spark.read.schema(_SCHEMA).parquet(out)
            state = found.filter("kind = 0").select("id", "vec", "bounds")
        sums = found.filter("kind = 1").groupBy("run", "cluster").agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).toArrow()  # no more than the centres
        shipped.unpersist()
        new_totals, new_counts = [t.copy() for t in totals], [c.copy() for c in counts]
        rows = block(sums.column("sums"))
        for at, (i, c, n) in enumerate(zip(*(sums.column(name).to_pylist() for name in ("run", "cluster", "n")))):
            new_totals[i][c] += rows[at]
            new_counts[i][c] += n
        if write:
            totals, counts, bases = new_totals, new_counts, [run.centres for run in runs]
        return new_totals, new_counts

    scans = 0
    while any(run.active for run in runs):
        scans += 1
        sums, sizes = scanned(scans & (scans - 1) == 0)
        for i, run in enumerate(runs):
            if run.active:
                full = sizes[i] > 0
                new = run.centres.copy()
                new[full] = sums[i][full] / sizes[i][full][:, None]
                steps[i] += 1
                moved = np.sqrt(((new - run.centres) ** 2).sum(axis=1)).max(initial=0.0)
                settled[i] = bool(moved <= tolerance)
                runs[i] = _Run.of(new, bases[i], steps[i] < max_iter and not settled[i])
            else:
                runs[i] = _Run.of(run.centres, bases[i], False)
    shipped, out = spark.sparkContext.broadcast(runs), scratch_path(spark, "lloyd")
    state.mapInArrow(lambda batches: _last(batches, shipped.value), _RESULT).write.parquet(out)
    discard(spark, path)
    state = spark.read.schema(_RESULT).parquet(out)
    cost = state.agg(*[F.sum(F.col("upper")[i] * F.col("upper")[i]).alias(f"c{i}") for i in range(len(ks))]).first()
    fits = {k: Fit(runs[i].centres, float(cost[i] or 0.0), steps[i], settled[i]) for i, k in enumerate(ks)}
    return JointFit(state, ks, fits, out)


def groups_of(ks: list[int], dims: int, limit_bytes: int = BROADCAST_BYTES) -> list[list[int]]:
    """The runs in groups whose centres fit `limit_bytes` together."""
    out, held = [[]], 0
    for k in sorted(ks):
        if 8 * k * dims > limit_bytes:
            raise ValueError(f"the centres of K={k} are too large to go to every executor")
        if out[-1] and held + 8 * k * dims > limit_bytes:
            out.append([])
            held = 0
        out[-1].append(k)
        held += 8 * k * dims
    return out
