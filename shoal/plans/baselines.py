"""Control labelings to compare a clustering against. All give (question_id, k, variant, cluster_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.hashing import digest, leading_bits, uniform
from shoal.functions.vectors import block, list_column, packed_column, squared_distances, unpacked, values
from shoal.operators.nearest import STRIP_BYTES, nearest_all
from shoal.operators.ordering import equal_count_buckets, with_row_number
from shoal.operators.reduce import fit, project
from shoal.operators.sampling import sample_ids
from shoal.plans.lloyd import groups_of
from shoal.session import discard, scratch_path

# Names of the control labelings and the grid of K.
UNIFORM_RANDOM = "baseline_uniform_random"
SHUFFLE_SIZE = "baseline_shuffle_size"
LENGTH_BUCKETS = "baseline_length_buckets"
PCA1_BUCKETS = "baseline_pca1_buckets"
RANDOM_CENTROID = "baseline_random_centroid"
KMEANSPP_ONE_SHOT = "baseline_kmeanspp_one_shot"
VARIANTS = [UNIFORM_RANDOM, SHUFFLE_SIZE, LENGTH_BUCKETS, PCA1_BUCKETS, RANDOM_CENTROID, KMEANSPP_ONE_SHOT]
KS = list(range(100, 1401, 100))

_COLUMNS = ["question_id", "k", "variant", "cluster_id"]


def _as_assignments(df: DataFrame, variant: str) -> DataFrame:
    return df.withColumn("variant", F.lit(variant)).select(*_COLUMNS)


def uniform_random(ids: DataFrame, ks: list[int], seed=42) -> DataFrame:
    """An independent uniform label in [0, k) per row and k. `ids(id)`"""
    labels = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.pmod(leading_bits(digest(F.col("id"), f"{seed}:{k}")), F.lit(k)).cast("int").alias("cluster_id"),
        )
        for k in ks
    ])
    return _as_assignments(ids.select(F.col("id").alias("question_id"), F.inline(labels)), UNIFORM_RANDOM)


def shuffle_size(true_labels: DataFrame, seed=42) -> DataFrame:
    """Permute the labels of `true_labels(question_id, k, cluster_id)`: cluster sizes stay, members are random.

    Rows are numbered once in md5 order; the label of a number is the cluster whose range of cumulative sizes
    contains it. Only the cluster sizes (one row per cluster and k) are shipped.
    """
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in true_labels.groupBy("k", "cluster_id").agg(F.count("*").alias("n")).orderBy("k", "cluster_id").collect():
        sizes.setdefault(r["k"], []).append((r["cluster_id"], r["n"]))
    ids = true_labels.select("question_id").distinct()
    permuted = with_row_number(ids.withColumn("_d", digest(F.col("question_id"), seed)), ["_d", "question_id"])
    tables = [
        (k, np.array([c for c, _ in rows], dtype=np.int32), np.cumsum([n for _, n in rows])) for k, rows in sizes.items()
    ]
    rows = permuted.count()
    for k, _, ends in tables:
        if ends[-1] != rows:
            raise ValueError(f"labels of k={k} cover {ends[-1]} of {rows} ids")
    shipped = true_labels.sparkSession.sparkContext.broadcast(tables)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = values(batch.column("rn"))
            for k, clusters, ends in shipped.value:
                at = np.searchsorted(ends, number, side="left")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("question_id"), pa.array(np.full(len(number), k, np.int32)), pa.array(clusters[at])],
                    names=["question_id", "k", "cluster_id"],
                )

    out = permuted.select(F.col("question_id").cast("long"), "rn").mapInArrow(
        label, "question_id long, k int, cluster_id int"
    )
    return _as_assignments(out, SHUFFLE_SIZE)


def length_buckets(meta: DataFrame, ks: list[int]) -> DataFrame:
    """Equal-count buckets of `meta(question_id, text_length)` by length, ties by id."""
    return _as_assignments(equal_count_buckets(meta, ["text_length"], ks, "question_id"), LENGTH_BUCKETS)


def pca1_buckets(vectors: DataFrame, ks: list[int]) -> DataFrame:
    """Equal-count buckets along the first principal component; one fit and one ordering for all k."""
    line = project(vectors, fit(vectors, 1)).select("id", F.col("vec")[0].alias("pc1"))
    return _as_assignments(equal_count_buckets(line, ["pc1"], ks), PCA1_BUCKETS)


def gaussian_directions(spark, k: int, dims: int, seed=42) -> DataFrame:
    """(cluster_id, vec): k unit vectors with Gaussian directions, by Box-Muller on md5 uniforms. k rows."""

    def normal(c, j):
        bits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), c.cast("string"), j.cast("string")))
        u1 = (leading_bits(bits) + 1) / F.lit(4294967296.0)
        u2 = leading_bits(F.substring(bits, 9, 8)) / F.lit(4294967296.0)
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)

    raw = spark.range(k).select(
        F.col("id").cast("int").alias("cluster_id"),
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: normal(F.col("id"), j)).alias("g"),
    )
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("_n", norm).select("cluster_id", F.transform("g", lambda x: x / F.col("_n")).alias("vec"))


def random_centroid(vectors: DataFrame, ks: list[int], seed=42) -> DataFrame:
    """Nearest of k random unit vectors, for all k in one scan; cells may stay empty."""
    spark = vectors.sparkSession
    dims = len(vectors.select("vec").first()["vec"])
    tables = {}
    for group in groups_of(ks, dims):  # what the driver holds is bounded by the k asked for, and measured
        drawn = None
        for k in group:
            rows = gaussian_directions(spark, k, dims, seed).withColumn("k", F.lit(k))
            drawn = rows if drawn is None else drawn.unionByName(rows)
        table = drawn.orderBy("k", "cluster_id").toArrow()
        of = values(table.column("k"))
        tables |= {k: block(table.column("vec"))[of == k] for k in group}
    return _as_assignments(nearest_all(vectors, tables).withColumnRenamed("id", "question_id"), RANDOM_CENTROID)


# -- one-shot seeding -----------------------------------------------------------------------------------------

_SEED_STATE = "id long, vec binary, near array<int>, cost array<double>"  # vectors as bytes


def _size_for(k: int) -> int:
    """Seeds are drawn for powers of two, so that those of a k do not depend on the others asked for."""
    return 1 << max(0, k - 1).bit_length()


def all_seeds(vectors: DataFrame, ks: list[int], seed=42, rounds: int = 5, oversample: float = 2.0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each k, ids and rows of k starting centres by D-squared sampling; every centre is a data row.

    A few rounds pick about `oversample * size` rows each (size is the next power of two), with chance in proportion to the squared
    distance to the rows picked so far; then weighted k-means++ runs over those candidates, a set whose size depends on k alone. One
    set of rounds serves all k: each row keeps its distance to the nearest candidate of every size, in a written table, and a round
    compares it with the new candidates only.
    """
    spark = vectors.sparkSession
    sizes = sorted({_size_for(k) for k in ks})
    plain = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    first = plain.join(F.broadcast(sample_ids(plain, 1, f"{seed}:0")), "id", "left_semi").toArrow()
    ids = {s: values(first.column("id")) for s in sizes}
    rows = {s: block(first.column("vec")) for s in sizes}
    state, path, new, number = plain, None, {s: (0, rows[s]) for s in sizes}, 0
    while True:
        state, path = _seed_scan(state, path, [new[s] for s in sizes])
        total = state.agg(*[F.sum(F.col("cost")[i]).alias(f"c{i}") for i in range(len(sizes))]).first()
        number += 1
        most = {s: max(k for k in ks if _size_for(k) == s) for s in sizes}
        wanted = [i for i, s in enumerate(sizes) if total[i] and (number <= rounds or len(ids[s]) < most[s])]
        if not wanted or number > rounds + 20:
            break
        chosen = {i: uniform(F.col("id"), f"{seed}:{sizes[i]}:{number}") < F.lit(oversample * sizes[i] / total[i]) * F.col("cost")[i] for i in wanted}
        drawn = state.select("id", "vec", F.array(*[chosen.get(i, F.lit(False)) for i in range(len(sizes))]).alias("of")).filter(F.exists("of", lambda x: x))
        table = drawn.orderBy("id").toArrow()  # about oversample * size rows a size
        of = block(table.column("of")).reshape(table.num_rows, len(sizes)) > 0
        found = values(table.column("id"))
        matrix = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(table.num_rows, -1) if table.num_rows else rows[sizes[0]][:0]
        for i, s in enumerate(sizes):
            at = np.flatnonzero(of[:, i])
            new[s] = (len(ids[s]), matrix[at])
            ids[s], rows[s] = np.concatenate([ids[s], found[at]]), np.vstack([rows[s], matrix[at]]) if len(at) else rows[s]
    weights = {s: np.zeros(len(ids[s])) for s in sizes}
    counted = state.select(F.posexplode("near").alias("i", "at")).groupBy("i", "at").agg(F.count("*").alias("n"))
    for r in counted.collect():  # a row to a candidate
        weights[sizes[r["i"]]][r["at"]] = r["n"]
    discard(spark, path)
    out = {}
    for k in ks:
        s = _size_for(k)
        own, matrix, weight = _filled(plain, ids[s], rows[s], weights[s], k, seed)
        chosen = _weighted_choice(matrix, weight, k, seed)
        out[k] = own[chosen], matrix[chosen]
    return out


def _seed_scan(state: DataFrame, path: str | None, new: list[tuple[int, np.ndarray]]) -> tuple[DataFrame, str]:
    """The rows with their nearest candidate and its squared distance for each size, after the new candidates (first number, rows)."""
    spark = state.sparkSession
    shipped, first, out = spark.sparkContext.broadcast(new), path is None, scratch_path(spark, "seeds")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = batch.num_rows, len(shipped.value)
            if n == 0:
                continue
            x = block(batch.column("vec")) if first else unpacked(batch.column("vec"), np.float64)
            near = np.zeros((n, sizes), np.int32) if first else block(batch.column("near")).astype(np.int32)
            cost = np.full((n, sizes), np.inf) if first else block(batch.column("cost")).copy()
            for i, (number, rows) in enumerate(shipped.value):
                if len(rows) == 0:
                    continue
                strip = max(1, STRIP_BYTES // (8 * len(rows)))
                for start in range(0, n, strip):
                    part = slice(start, start + strip)
                    dist = squared_distances(x[part], rows)
                    best = dist.argmin(axis=1)
                    diff = x[part] - rows[best]
                    least = np.einsum("ij,ij->i", diff, diff)  # exact, so that a copy of a candidate costs nothing
                    closer = least < cost[part, i]
                    cost[part, i] = np.where(closer, least, cost[part, i])
                    near[part, i] = np.where(closer, number + best, near[part, i])
            offsets = pa.array(np.arange(0, (n + 1) * sizes, sizes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), packed_column(x), pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1))), list_column(cost)],
                names=["id", "vec", "near", "cost"])

    state.mapInArrow(compare, _SEED_STATE).write.parquet(out)
    if path is not None:
        discard(spark, path)
    return spark.read.schema(_SEED_STATE).parquet(out), out


def _filled(vectors: DataFrame, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int, seed):
    """Candidates with further rows in md5 order where there are fewer distinct rows than centres."""
    if len(ids) < k:
        more = vectors.join(F.broadcast(sample_ids(vectors, k + len(ids), f"{seed}:fill")), "id", "left_semi").orderBy("id").toArrow()
        fresh = np.flatnonzero(~np.isin(values(more.column("id")), ids))[:k - len(ids)]
        ids = np.concatenate([ids, values(more.column("id"))[fresh]])
        rows, weights = np.vstack([rows, block(more.column("vec"))[fresh]]), np.concatenate([weights, np.ones(len(fresh))])
    if len(ids) < k:
        raise ValueError(f"{len(ids)} rows cannot give {k} centres")
    return ids, rows, weights


def seed_centres(vectors: DataFrame, k: int, seed=42) -> tuple[np.ndarray, np.ndarray]:
    """`all_seeds` for one k."""
    return all_seeds(vectors, [k], seed)[k]


def _weighted_choice(rows: np.ndarray, weights: np.ndarray, k: int, seed) -> np.ndarray:
    rng = np.random.default_rng(seed)
    open_rows = np.ones(len(rows), dtype=bool)
    chosen = [int(rng.choice(len(rows), p=weights / weights.sum()))]
    open_rows[chosen[0]] = False
    dist = squared_distances(rows, rows[chosen]).ravel()
    while len(chosen) < k:
        chance = np.where(open_rows, weights * dist, 0.0)
        if chance.sum() <= 0:
            chance = open_rows.astype(float)
        pick = int(rng.choice(len(rows), p=chance / chance.sum()))
        chosen.append(pick)
        open_rows[pick] = False
        dist = np.minimum(dist, squared_distances(rows, rows[[pick]]).ravel())
    return np.array(chosen)


def kmeanspp_one_shot(vectors: DataFrame, ks: list[int], seed=42) -> DataFrame:
    """One assignment to k-means++ starting centres, without iterations, for all k in one scan."""
    centres = {k: rows for k, (_, rows) in all_seeds(vectors, ks, seed).items()}
    return _as_assignments(nearest_all(vectors, centres).withColumnRenamed("id", "question_id"), KMEANSPP_ONE_SHOT)


def all_baselines(vectors: DataFrame, meta: DataFrame, true_labels: DataFrame, ks: list[int], seed=42) -> DataFrame:
    """The six control labelings for every k."""
    parts = [
        uniform_random(vectors.select("id"), ks, seed),
        shuffle_size(true_labels.filter(F.col("k").isin(ks)), seed),
        length_buckets(meta, ks),
        pca1_buckets(vectors, ks),
        random_centroid(vectors, ks, seed),
        kmeanspp_one_shot(vectors, ks, seed),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
