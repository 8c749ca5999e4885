"""Exact top-k inner products by an impact-ordered index, read a score at a time.

Components become integers, floor(`SCALE` * x). The rows are dealt by a hash into shards of bounded size. A shard's index has, for
each dimension, posting segments: the rows whose component lies in one of `LEVELS` equal steps of that dimension's range, with the
smallest and largest component among them. For a query, a segment's quantised impact is the most that it can add to a score: the
query's component times one of these two.

A query reads the segments of all dimensions by descending impact and adds the impact to an accumulator for each row of a segment.
What a row has not been met in yet is bounded by the next impact of that dimension, so accumulator and bounds together are an upper
bound of its score. Reading stops on proof only: when all but a small share of the rows have an upper bound below the k-th best
exact score known so far. The rows that are left, the possible members, are rescored exactly. Where the proof does not come, more segments are
read, in the end all; then too every row that is not rescored is ruled out by its bound.

A task goes through its shards with the best k of each query in hand, and hands on k rows for each query. Queries are broadcast in
blocks of at most `BLOCK_BYTES`, a job to a block, so neither they nor the candidates are ever gathered, and each row of the index meets
each query in some block.

Vectors that are null, or hold a null or a component that is not finite, take no part. Components beyond `LIMIT` / `SCALE` count
as that. Shorter vectors are filled with zeros. Rows that repeat an id are candidates (and queries) of their own; only a query's own row
is not its candidate. Ties go to the smaller id, null ids last; a null id is no query. Other columns are ignored. A table without
queries gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.scratch import saved

SCALE = 256
LIMIT = 1 << 25  # so that sums of products stay exact in 64 bits up to 8,192 dimensions
SHARD_ROWS = 4096
SHARD_CELLS = 1 << 19
LEVELS = 32
BLOCK_BYTES = 16 << 20
FIRST_SHARE = 0.35  # of the postings, read before the first look at the bounds
POSSIBLE = 0.05  # share of a shard's rows that are rescored without reading on
_PARTS = ["ids", "known", "lines", "vectors", "postings", "ends", "low", "high"]
_INDEX = "shard int, rows int, " + ", ".join(f"{c} binary" for c in _PARTS)
_FOUND = "query long, query_id long, vec_id long, line long, score long"


def integers(vector: Column) -> Column:
    """The integer components; null if the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return F.when(sound, scaled)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer lists as rows, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def shard_rows(width: int) -> int:
    return max(256, min(SHARD_ROWS, SHARD_CELLS // max(width, 1)))


def shard_of(table: pa.Table, width: int) -> dict:
    """The arrays of a shard over the rows of `table(line, vec_id, vec)`."""
    ids, line = table.column("vec_id"), table.column("line").to_numpy()
    known = ids.is_valid().to_numpy()
    ids = ids.fill_null(0).to_numpy()
    order = np.lexsort((line, ids, ~known))  # of equal scores the first row in a shard wins
    v = _matrix(table.column("vec"), width)[order]
    n = len(v)
    postings, ends = np.zeros((width, n), np.uint16 if n <= 1 << 16 else np.uint32), np.zeros((width, LEVELS + 1), np.int32)
    low, high = np.zeros((width, LEVELS), np.int32), np.zeros((width, LEVELS), np.int32)
    for d in range(width):
        c = v[:, d].astype(np.int64)
        step = max(1, -(-(c.max() - c.min() + 1) // LEVELS))
        level = (c - c.min()) // step
        at = np.argsort(level, kind="stable")
        postings[d] = at
        ends[d, 1:] = np.cumsum(np.bincount(level, minlength=LEVELS))
        full = np.flatnonzero(np.diff(ends[d]))
        low[d, full] = np.minimum.reduceat(c[at], ends[d, full])
        high[d, full] = np.maximum.reduceat(c[at], ends[d, full])
    parts = [ids[order].astype(np.int64), known[order], line[order].astype(np.int64), v, postings, ends, low, high]
    return {"rows": n} | {c: p.tobytes() for c, p in zip(_PARTS, parts)}


def index(vectors: DataFrame, width: int, rows: int) -> DataFrame:
    """Shards over `vectors(line, vec_id, vec)`, a row to a shard, its arrays as bytes."""
    shards = max(1, -(-rows // shard_rows(width)))
    schema = pa.schema([("shard", pa.int32()), ("rows", pa.int32()), *[(c, pa.binary()) for c in _PARTS]])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"shard": key[0].as_py()} | shard_of(table, width)], schema=schema)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("line"), F.lit(shards)).cast("int"))
    return saved(dealt.groupBy("shard").applyInArrow(build, _INDEX), "impacts")


class Shard:
    def __init__(self, record: dict, width: int):
        n = record["rows"]
        get = lambda c, kind: np.frombuffer(record[c], kind)
        self.n, self.width = n, width
        self.ids, self.known, self.lines = get("ids", np.int64), get("known", bool), get("lines", np.int64)
        self.vectors = get("vectors", np.int32).reshape(n, width)
        self.postings = get("postings", np.uint16 if n <= 1 << 16 else np.uint32).reshape(width, n).astype(np.int64)
        self.ends = get("ends", np.int32).reshape(width, LEVELS + 1).astype(np.int64)
        self.low, self.high = (get(c, np.int32).reshape(width, LEVELS).astype(np.float64) for c in ("low", "high"))
        self.counts = np.diff(self.ends, axis=1)

    def bounds(self, query: np.ndarray, share: float) -> np.ndarray:
        """Upper bounds of all scores after the segments with the highest impacts, so many that they hold `share` of the postings."""
        impact = np.where(query[:, None] < 0, query[:, None] * self.low, query[:, None] * self.high)
        impact[self.counts == 0] = -np.inf
        impact[query == 0] = -np.inf  # adds nothing
        flat, postings = impact.ravel(), self.counts.ravel()
        order = np.argsort(-flat)
        order = order[:np.count_nonzero(np.isfinite(flat))]
        reached = np.cumsum(postings[order])
        upto = np.searchsorted(reached, share * reached[-1]) + 1 if len(order) else 0
        read = np.zeros(flat.shape, bool)
        read[order[:upto]] = True
        read = read.reshape(impact.shape)
        left = np.where(read, -np.inf, impact).max(axis=1, initial=-np.inf)  # the next impact of each dimension
        left[~np.isfinite(left)] = 0.0
        weights = impact - left[:, None]
        pieces, adds = [], []
        for d in np.flatnonzero(read.any(axis=1)):
            levels = np.flatnonzero(read[d])  # one end of the dimension's levels, but for empty ones
            pieces.append(self.postings[d, self.ends[d, levels[0]]:self.ends[d, levels[-1] + 1]])
            adds.append(np.repeat(weights[d, levels], self.counts[d, levels]))
        if not pieces:
            return np.full(self.n, left.sum())
        return left.sum() + np.bincount(np.concatenate(pieces), weights=np.concatenate(adds), minlength=self.n)

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ query


class Best:
    """The best k of a query so far, as (score, not known, id, line) in order."""

    def __init__(self, k: int):
        self.k, self.rows, self.share = k, [], FIRST_SHARE

    def least(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def search(self, shard: Shard, query: np.ndarray, line: int) -> None:
        whole = query.astype(np.int64)
        slack = 1e-12 * float(np.abs(whole) @ np.maximum(np.abs(shard.low), np.abs(shard.high)).max(axis=1, initial=0.0)) if shard.width else 0.0
        slack = 0.0 if slack < 4096.0 else slack  # sums below 2 ** 52 are exact
        while True:
            upper = shard.bounds(query, self.share)
            least = self.least()
            if least == -np.inf and shard.n:  # some exact scores to begin with
                top = np.argpartition(-upper, min(self.k, shard.n - 1))[:self.k + 1]
                first = np.sort(shard.exact(whole, top[shard.lines[top] != line]))[::-1]
                known = sorted([r[0] for r in self.rows] + first.tolist(), reverse=True)
                least = known[self.k - 1] if len(known) >= self.k else -np.inf
            possible = np.flatnonzero(upper >= least - slack)
            if len(possible) <= max(4 * self.k, POSSIBLE * shard.n) or self.share >= 1.0:
                break
            self.share = min(1.0, self.share * 1.4)
        possible = possible[shard.lines[possible] != line]
        scores = shard.exact(whole, possible)
        top = np.argsort(-scores, kind="stable")[:self.k]
        at = possible[top]
        found = zip(scores[top].tolist(), (~shard.known[at]).tolist(), shard.ids[at].tolist(), shard.lines[at].tolist())
        self.rows = sorted(self.rows + list(found), key=lambda r: (-r[0], *r[1:]))[:self.k]


def top_k(vectors: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which `asks` is true, fewer if there are fewer."""
    spark = vectors.sparkSession
    rows = saved(vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector)).alias("vec"), asks.alias("asks"),
        F.monotonically_increasing_id().alias("line")).filter("vec IS NOT NULL"), "vectors")
    asked = rows.filter("asks AND vec_id IS NOT NULL")
    sizes = rows.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width"), F.count_if(F.col("asks") & F.col("vec_id").isNotNull()).alias("asked")).first()
    width = sizes["width"] or 0
    if not sizes["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = index(rows.select("line", "vec_id", "vec"), width, sizes["rows"])
    blocks = -(-sizes["asked"] * (4 * width + 16) // block_bytes)
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("line", F.lit("block")), F.lit(blocks)) == block)
        part = saved(_searched(shards, own, width, k), "found")
        found = found.unionByName(part) if found else part
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "line")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(shards: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """The best k of each query in each task's shards; `asked` is a block of queries of bounded size."""
    table = asked.select("line", "vec_id", "vec").toArrow()
    queries = shards.sparkSession.sparkContext.broadcast(
        (table.column("line").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("vec"), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, ids, matrix = queries.value
        best = [Best(k) for _ in lines]
        for batch in batches:
            for record in batch.to_pylist():
                shard = Shard(record, width)
                for b, line, query in zip(best, lines.tolist(), matrix):
                    b.search(shard, query.astype(np.float64), line)
        out = [(line, i, row[2] if not row[1] else None, row[3], row[0]) for b, line, i in zip(best, lines.tolist(), ids.tolist()) for row in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query", "query_id", "vec_id", "line", "score"])

    return shards.select("rows", *_PARTS).mapInArrow(run, _FOUND)
