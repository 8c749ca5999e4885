"""K-means inside many clusters at once, on sparse rows.

All clusters take a step in the same job. Rows are packed once, a row's terms as bytes that Spark hands on without looking into them; a scan meets each row with the centres of its own
cluster only, adds the rows up per (cluster, centre, term) in the task, and just these sums are shuffled. Centres are shipped for groups of
clusters whose centres together fit a broadcast, by the count of their distinct terms. A cluster of any size is spread over tasks.

Where weights are counts times a factor of the term, over the length of the row, the rows keep the counts, an eighth of the bytes. A step runs in
a few tasks for each core, so its sums do not grow with the input; they and the centres shipped go as the step ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.hashing import uniform
from shoal.functions.vectors import bytes_column, bytes_lists, steps, unstepped, values
from shoal.operators.grams import TASKS_A_CORE
from shoal.session import BROADCAST_BYTES, dropped, shuffles_dropped, stored

MAX_ITER = 20
TOLERANCE = 1e-4
MAX_TABLE = 1 << 24
CODES_AT_ONCE = 1024
CELLS_AT_ONCE = 1 << 19
_CELL = np.dtype([("code", "<i4"), ("centre", "<i4"), ("w", "<f8")])


@dataclass
class Centres:
    """Of one cluster: the sorted codes of its terms, k x codes weights, and the squared lengths."""

    codes: np.ndarray
    matrix: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.matrix, self.matrix)


@dataclass
class Subclusters:
    """`labels(id, cluster_id, subtopic)`, the squared `distance` of each row to its centre, and the centres by cluster.

    `sums(cluster_id, subtopic, code, weight)`, if asked for: the weights added up by label.
    """

    labels: DataFrame
    distances: DataFrame
    centres: dict[int, Centres]
    sums: DataFrame | None = None


@dataclass
class Counts:
    """Weights as `rows(id, codes, counts, norm)`: a weight is count * factors[code] / norm, where a null norm is the length of the row itself.

    Codes (as steps) and counts are int arrays as bytes; `single`: an id has one row at most.
    """

    rows: DataFrame
    factors: Broadcast
    single: bool


def packed(weights: DataFrame | Counts, clusters: DataFrame) -> DataFrame:
    """(id, cluster, codes, weights), int and double arrays as bytes, of `weights(id, code, weight)` or `weights(id, cells(code, weight))`.

    Cells of an id are in order of code. Rows of `clusters(id, cluster_id)` without any term have empty arrays. `Counts` stay counts: they
    give (id, cluster, codes, counts, norm).
    """
    if isinstance(weights, Counts):
        return _packed_counts(weights, clusters)
    pair = lambda c: F.struct(c["code"].alias("code"), c["weight"].alias("weight"))
    known = weights.filter(F.col("id").isNotNull())
    if "cells" in weights.columns:  # lists in order of code; most ids have a single one
        lists = known.groupBy("id").agg(F.collect_list(F.transform("cells", pair)).alias("lists"))
        cells = lists.select("id", F.when(F.size("lists") == 1, F.col("lists")[0]).otherwise(F.array_sort(F.flatten("lists"))).alias("cells"))
    else:
        cells = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "weight"))).alias("cells"))
    cells = clusters.select("id", F.col("cluster_id").cast("long").alias("cluster")).join(cells, "id", "left")
    empty = F.array().cast("array<struct<code:int,weight:double>>")
    cells = cells.select("id", "cluster", F.coalesce(F.col("cells").cast("array<struct<code:int,weight:double>>"), empty).alias("cells"))
    id_type = cells.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("cells")
            offsets, flat = column.offsets.to_numpy(), column.flatten()
            offsets = offsets - offsets[0]
            arrays = [bytes_column(offsets, values(flat.field(c)).astype(t)) for c, t in (("code", np.int32), ("weight", np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), *arrays], names=["id", "cluster", "codes", "weights"])

    return stored(cells.mapInArrow(run, f"id {id_type}, cluster long, codes binary, weights binary"), "packed")


def _packed_counts(weights: Counts, clusters: DataFrame) -> DataFrame:
    known = weights.rows.filter(F.col("id").isNotNull())
    if not weights.single:
        known = _merged(known)
    rows = clusters.select("id", F.col("cluster_id").cast("long").alias("cluster")).join(known, "id", "left")
    empty = F.expr("X''")
    return stored(rows.select("id", "cluster", F.coalesce("codes", empty).alias("codes"), F.coalesce("counts", empty).alias("counts"), "norm"), "packed")


def _merged(rows: DataFrame) -> DataFrame:
    """The cells of all rows of an id as one row, in order of code and count; rows that share an id have its norm."""
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("codes", "counts")).alias("lists"), F.max("norm").alias("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("lists")
            parts = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            offsets, codes = bytes_lists(flat.field("codes"), np.int32)
            codes, counts = unstepped(offsets, codes), bytes_lists(flat.field("counts"), np.int32)[1]
            ends = offsets[np.append(0, np.cumsum(parts))]
            row = np.repeat(np.arange(len(parts)), np.diff(ends))
            order = np.lexsort((counts, codes, row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), bytes_column(ends, steps(ends, codes[order])), bytes_column(ends, counts[order]), batch.column("norm")],
                names=["id", "codes", "counts", "norm"])

    return lists.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, codes binary, counts binary, norm double")


def row_cells(batch: pa.RecordBatch, factors: Broadcast | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, codes and weights of the cells of packed rows, or of `Counts` with their factors."""
    offsets, codes = bytes_lists(batch.column("codes"), np.int32)
    if factors is None:
        return offsets, codes, bytes_lists(batch.column("weights"), np.float64)[1]
    codes = unstepped(offsets, codes)
    weights = bytes_lists(batch.column("counts"), np.int32)[1] * factors.value[codes]
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    # squares are added one after the other, as Spark adds them
    own = np.sqrt(np.bincount(row, weights=weights * weights, minlength=batch.num_rows))
    norm = values(batch.column("norm")).astype(np.float64)
    return offsets, codes, weights / np.where(np.isnan(norm), own, norm)[row]


class _Places:
    """Where a code stands among the codes of some centres; beyond all of them if it is not there."""

    def __init__(self):
        self.table = np.zeros(0, np.int32)

    def __call__(self, known: np.ndarray, codes: np.ndarray) -> np.ndarray:
        none = len(known)
        if none == 0:
            return np.zeros(len(codes), np.int64)
        if known[-1] >= MAX_TABLE:
            place = np.minimum(np.searchsorted(known, codes), none - 1)
            return np.where(known[place] == codes, place, none)
        if known[-1] + 2 > len(self.table):
            self.table = np.full(int(known[-1]) + 2, -1, np.int32)  # the last entry is never set
        self.table[known] = np.arange(none)
        place = self.table[np.minimum(codes, len(self.table) - 1)]
        self.table[known] = -1
        return np.where(place < 0, none, place)


class _Rows:
    """The rows of a batch that belong to one cluster, their cells end to end."""

    def __init__(self, at: np.ndarray, offsets: np.ndarray, codes: np.ndarray, weights: np.ndarray, places: _Places):
        lengths = offsets[at + 1] - offsets[at]
        self.at, self.row, self._places = at, np.repeat(np.arange(len(at)), lengths), places
        if len(at) == len(offsets) - 1:  # all of them, in order
            self.codes, self.weights = codes, weights
        else:
            cells = np.repeat(offsets[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            self.codes, self.weights = codes[cells], weights[cells]
        self.lengths = self._sums(self.weights ** 2)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """Sums by row, added one after the other: rows that share no term with a centre tie but for the last digits."""
        return np.bincount(self.row, weights=x, minlength=len(self.at))

    def distances(self, centres: Centres) -> np.ndarray:
        """Squared distances (rows x centres)."""
        place = self._places(centres.codes, self.codes)
        dots = np.column_stack([self._sums(self.weights * np.append(c, 0.0)[place]) for c in centres.matrix])
        return np.maximum(self.lengths[:, None] - 2.0 * dots + centres.lengths[None, :], 0.0)


def _by_cluster(batches: Iterator[pa.RecordBatch], places: _Places, factors: Broadcast | None) -> Iterator[tuple[pa.RecordBatch, int, _Rows]]:
    """(batch, cluster, its rows) of up to CELLS_AT_ONCE cells, or one longer row, at a time."""
    for whole in batches:
        ends, at = bytes_lists(whole.column("codes"), np.int32)[0], 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS_AT_ONCE, side="right")) - 1)
            batch, at = whole.slice(at, to - at), to
            cluster = values(batch.column("cluster"))
            offsets, codes, weights = row_cells(batch, factors)
            order = np.argsort(cluster, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
                yield batch, int(cluster[rows[0]]), _Rows(rows, offsets, codes, weights, places)


def _terms(rows: DataFrame) -> DataFrame:
    """(cluster, terms): the number of distinct codes of each cluster. A task hands on its own, once each, in bytes."""
    stepped = "counts" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cluster = values(batch.column("cluster"))
            offsets, codes = bytes_lists(batch.column("codes"), np.int32)
            codes = unstepped(offsets, codes) if stepped else codes
            of = np.repeat(cluster, np.diff(offsets))
            for name in np.unique(cluster).tolist():
                parts = held.setdefault(name, [])
                parts.append(np.unique(codes[of == name]) if (cluster != name).any() else np.unique(codes))
                if len(parts) > 8:
                    held[name] = [np.unique(np.concatenate(parts))]
        for name, parts in held.items():
            found = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([steps(np.array([0, len(found)]), found).tobytes()])], names=["cluster", "codes"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int32)
        for c in table.column("codes"):
            found = np.union1d(found, np.cumsum(np.frombuffer(c.as_py(), np.int32)))
        return pa.table({"cluster": [key[0].as_py()], "terms": [len(found)]})

    return rows.select("cluster", "codes").mapInArrow(run, "cluster long, codes binary").groupBy("cluster").applyInArrow(merged, "cluster long, terms long")


def _scan(rows: DataFrame, factors: Broadcast | None, centres: dict[int, Centres], emit: Callable, schema: str) -> tuple[DataFrame, Broadcast]:
    """`emit(batch, cluster, rows, centres)` for all rows of the clusters that have centres, and the centres shipped, to be destroyed."""
    shipped = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cluster, part in _by_cluster(batches, _Places(), factors):
            if cluster in shipped.value:
                yield from emit(batch, cluster, part, shipped.value[cluster])

    return rows.mapInArrow(run, schema), shipped


def _labelled(batch: pa.RecordBatch, cluster: int, rows: _Rows, centres: Centres) -> Iterator[pa.RecordBatch]:
    dist = rows.distances(centres)
    best = dist.argmin(axis=1)
    yield pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(rows.at)), pa.array(np.full(len(best), cluster)), pa.array(best.astype(np.int32)),
         pa.array(dist[np.arange(len(best)), best])], names=["id", "cluster_id", "subtopic", "distance"])


def _seeds(rows: DataFrame, factors: Broadcast | None, clusters: list[int], k: int, seed: int) -> dict[int, Centres]:
    """k-means++ in all clusters at once: a round draws one more row for each cluster, with chance in proportion to its squared distance.

    The row with the least -log(u) / distance is drawn, u fixed by its id, so a round is one aggregate. A cluster whose rows all are
    seeds or copies of them gets no more.
    """
    drawn: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in clusters}
    for number in range(k):
        with_u = rows.withColumn("u", uniform(F.col("id"), f"{seed}:{number}"))
        centres = {c: _centres(s) for c, s in drawn.items() if s} if number else {c: Centres(np.zeros(0, np.int32), np.zeros((1, 0))) for c in clusters}

        def keyed(batch, cluster, part, own, first=number == 0):
            far = np.ones(len(part.at)) if first else part.distances(own).min(axis=1)
            far[far < 1e-12] = 0.0
            with np.errstate(divide="ignore"):
                key = -np.log(np.maximum(values(batch.column("u"))[part.at], 1e-300)) / far
            best = int(key.argmin())
            if np.isfinite(key[best]):  # the best of a batch is enough
                own = part.row == best
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cluster]), pa.array([key[best]]), batch.column("id").take(pa.array([part.at[best]])),
                     *[pa.array([x[own].tobytes()]) for x in (part.codes, part.weights)]], names=["cluster", "key", "id", "codes", "weights"])

        id_type = rows.schema["id"].dataType.simpleString()
        found, shipped = _scan(with_u, factors, centres, keyed, f"cluster long, key double, id {id_type}, codes binary, weights binary")
        best = F.min_by(F.struct("codes", "weights"), F.struct("key", "id")).alias("s")
        with shuffles_dropped(rows.sparkSession):
            for r in found.groupBy("cluster").agg(best).collect():  # a row to a cluster
                drawn[r["cluster"]].append((np.frombuffer(r["s"]["codes"], np.int32), np.frombuffer(r["s"]["weights"], np.float64)))
        shipped.destroy()
    return {c: _centres(s) for c, s in drawn.items() if s}


def _centres(rows: list[tuple[np.ndarray, np.ndarray]]) -> Centres:
    codes = np.unique(np.concatenate([c for c, _ in rows]))
    matrix = np.zeros((len(rows), len(codes)))
    for i, (c, w) in enumerate(rows):
        matrix[i, np.searchsorted(codes, c)] = w
    return Centres(codes, matrix)


def _by_nearest(rows: DataFrame, factors: Broadcast | None, centres: dict[int, Centres]) -> tuple[DataFrame, Broadcast]:
    """(cluster, centre, code, w): the sums of the rows by their nearest centre, their number as code -1; and the centres shipped, to be destroyed.

    A task adds up its rows and hands on one row of bytes for each cluster and CODES_AT_ONCE codes; these are added up by group.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for _, cluster, part in _by_cluster(batches, _Places(), factors):
            if cluster not in shipped.value:
                continue
            parts = held.setdefault(cluster, [])
            parts.append(_sums(part, shipped.value[cluster]))
            if len(parts) > 8:
                held[cluster] = [_added(np.concatenate(parts))]
        for cluster, parts in held.items():
            cells = _added(np.concatenate(parts))  # in order of code
            block = cells["code"] // CODES_AT_ONCE
            first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            offsets = np.append(first, len(cells))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), cluster, np.int64)), pa.array(block[first].astype(np.int32)), bytes_column(offsets, cells)],
                names=["cluster", "block", "cells"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        cells = _added(np.frombuffer(b"".join(table.column("cells").to_pylist()), _CELL))
        return pa.table({"cluster": np.full(len(cells), key[0].as_py(), np.int64), **{c: cells[c].copy() for c in ("centre", "code", "w")}})

    found = rows.mapInArrow(run, "cluster long, block int, cells binary")
    return found.groupBy("cluster", "block").applyInArrow(merged, "cluster long, centre int, code int, w double"), shipped


def _step(rows: DataFrame, factors: Broadcast | None, centres: dict[int, Centres]) -> dict[int, Centres]:
    """The means of the rows by their nearest centre; a centre without rows stays."""
    with shuffles_dropped(rows.sparkSession):
        found, shipped = _by_nearest(rows, factors, centres)
        table = found.toArrow()  # no more than the centres, which are measured
    shipped.destroy()
    cluster, centre, code, w = (values(table.column(c)) for c in ("cluster", "centre", "code", "w"))
    order = np.argsort(cluster, kind="stable")
    out = {}
    for at in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        name = int(cluster[at[0]])
        own = centres[name]
        n = np.zeros(len(own.matrix))
        counted = at[code[at] < 0]
        n[centre[counted]] = w[counted]
        at = at[code[at] >= 0]
        codes = np.union1d(own.codes, code[at]).astype(np.int32)
        matrix = np.zeros((len(n), len(codes)))
        matrix[centre[at], np.searchsorted(codes, code[at])] = w[at]
        full = n > 0
        matrix[full] /= n[full][:, None]
        matrix[~full] = 0.0
        matrix[np.ix_(~full, np.searchsorted(codes, own.codes))] = own.matrix[~full]
        used = matrix.any(axis=0)
        out[name] = Centres(codes[used], matrix[:, used])
    return out


def _sums(part: _Rows, own: Centres) -> np.ndarray:
    """Cells of the sums of the rows by their nearest centre; code -1 holds their number."""
    label = part.distances(own).argmin(axis=1)
    width, k = int(part.codes.max(initial=-1)) + 1, len(own.matrix)
    if width * k <= 4 * len(part.codes):  # so many cells that a sum for each code takes less than sorting them
        codes, place = np.arange(width), part.codes
    else:
        codes, place = np.unique(part.codes, return_inverse=True)
    total = np.bincount(label[part.row] * max(len(codes), 1) + place, weights=part.weights, minlength=k * max(len(codes), 1))
    full = np.flatnonzero(total)
    cells = np.zeros(k + len(full), _CELL)
    cells["centre"] = np.concatenate([np.arange(k), full // max(len(codes), 1)])
    cells["code"] = np.concatenate([np.full(k, -1), codes[full % max(len(codes), 1)] if len(codes) else np.zeros(0, int)])
    cells["w"] = np.concatenate([np.bincount(label, minlength=k), total[full]])
    return cells


def _added(cells: np.ndarray) -> np.ndarray:
    """Cells of equal code and centre as one, in order of both."""
    key = cells["code"].astype(np.int64) << 32 | cells["centre"]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=np.iinfo(np.int64).min))
    out = cells[order[first]]
    if len(first):
        out["w"] = np.add.reduceat(cells["w"][order], first)
    return out


def _moved(before: Centres, after: Centres) -> float:
    codes = np.union1d(before.codes, after.codes)
    both = np.zeros((2, len(before.matrix), len(codes)))
    for i, c in enumerate((before, after)):
        both[i][:, np.searchsorted(codes, c.codes)] = c.matrix
    return float(np.sqrt(((both[0] - both[1]) ** 2).sum(axis=1)).max(initial=0.0))


def subtopics_of_clusters(weights: DataFrame | Counts, clusters: DataFrame, k: int, seed: int = 42, max_iter: int = MAX_ITER,
                          limit_bytes: int = BROADCAST_BYTES, with_sums: bool = False) -> Subclusters:
    """K-means with k centres in each cluster of `clusters(id, cluster_id)`, on `weights(id, code, weight)`, lists of these, or `Counts`.

    Clusters with fewer distinct rows than k get fewer subtopics. Each cluster ends as if it were clustered alone: once none of its centres moves by
    more than TOLERANCE, or after `max_iter` steps.
    """
    factors = weights.factors if isinstance(weights, Counts) else None
    kept = packed(weights, clusters)
    spark = kept.sparkSession
    rows = kept.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    # A cluster's centres have at most its distinct terms, and at most its cells.
    with shuffles_dropped(spark):
        terms = _terms(rows).orderBy("cluster").collect()  # a row to a cluster
    groups, held = [[]], 0
    for r in terms:
        size = r["terms"] * (8 * k + 4)
        if size > limit_bytes:
            raise ValueError(f"the centres of cluster {r['cluster']} take {size} bytes; use a smaller vocabulary")
        if groups[-1] and held + size > limit_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r["cluster"])
        held += size
    done, labels, sums = {}, [], []
    id_type = kept.schema["id"].dataType.simpleString()
    for group in groups:
        own = rows.filter(F.col("cluster").between(group[0], group[-1])) if len(groups) > 1 else rows
        open_centres, settled = _seeds(own, factors, group, k, seed), {}
        for _ in range(max_iter):
            if not open_centres:
                break
            after = _step(own, factors, open_centres)
            still = {c for c, m in after.items() if _moved(open_centres[c], m) > TOLERANCE}
            settled |= {c: m for c, m in after.items() if c not in still}
            open_centres = {c: after[c] for c in still}
        centres = settled | open_centres
        part, shipped = _scan(own, factors, centres, _labelled, f"id {id_type}, cluster_id long, subtopic int, distance double")
        labels.append(stored(part, "labels"))
        shipped.destroy()
        if with_sums:
            part, shipped = _by_nearest(own, factors, centres)
            part = part.filter("code >= 0").select(F.col("cluster").alias("cluster_id"), F.col("centre").alias("subtopic"), "code", F.col("w").alias("weight"))
            sums.append(stored(part, "sums"))
            shipped.destroy()
        done |= centres
    dropped(kept)
    labels = reduce(DataFrame.unionByName, labels)
    return Subclusters(labels.drop("distance"), labels, done, reduce(DataFrame.unionByName, sums) if sums else None)
