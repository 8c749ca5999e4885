"""Prefix trie of conversations, its node table addressed by minimal perfect hashes.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. The digest of a prefix is the
XOR of hashes of (position, turn), two lanes of 64 bits, so that digests follow from a range shuffle and running XORs whose state is carried
from one partition to the next: a conversation of any length is spread. Equal digests are verified: all rows of a node must have one depth, one
last turn (by sha256) and one parent node; else the digests are made anew with another seed.

The nodes of a shard get slots by a minimal perfect hash (`Slots`): at each level the digests that meet no other take a bit of a
table, the others go on; a slot is the number of bits before. Each slot holds its digest, so a lookup of an absent one is found out.
Counts are scattered into flat arrays by slot, parents become an array of slots, and subtrees are added up through it from the
deepest nodes to the highest.

A shard holds whole units: a unit is the subtree of a highest node over at most `UNIT_ROWS` turns of members. The nodes above, few
unless conversations are very long, add up their subtrees by doubling: in each round a node gets the sums of the nodes 1, 2, 4, ...
levels below, so a chain as long as the table takes a logarithm of rounds. Ids of members that end in a node are hashed in
order: pieces of up to `PIECE` ids are joined where a range shuffle has put them, then one task streams a node's pieces.

Nulls: null roles and texts are empty, null turns come first, rows without a conv_id take no part. Turns of a conversation with equal
numbers stand in order of their sha256; rows that repeat are turns of their own. An empty table has no nodes, not even a root. Other columns are
ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import bucket_of, ranked, saved, small

UNIT_ROWS = 1 << 16
SHARD_NODES = 1 << 18
PIECE = 4096
NODE = ["d1", "d2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


# -- sequences ------------------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, rank, n, sha, size): the turns of each conversation in order, by the sha256 of role and text and the bytes of the text."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary")
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.sha2(whole, 256)).alias("sha"),
        F.octet_length(what).cast("long").alias("size"))
    return ranked(saved(rows, "turns"), ["conv"], ["turn", "sha"]).select("conv", "rank", "n", "sha", "size")


def whole_sequences(turns: DataFrame) -> DataFrame:
    """(conv, pos, len, sha, size) of conversations as they are; position 0, without a turn, stands for the root."""
    roots = turns.groupBy("conv").agg(F.max("n").alias("len")).select(
        "conv", F.lit(0).cast("long").alias("pos"), "len", F.lit(None).cast("binary").alias("sha"), F.lit(0).cast("long").alias("size"))
    return saved(roots.unionByName(turns.select("conv", (F.col("rank") + 1).alias("pos"), F.col("n").alias("len"), "sha", "size")), "sequences")


def grafted_sequences(turns: DataFrame, span: int = 5, most: int = 9) -> DataFrame:
    """Like `whole_sequences`, but conversation c begins with the first h turns of conversation c - c % span, and its own first h turns are
    left out; h is the crc32 of c modulo `most`."""
    convs = saved(turns.groupBy("conv").agg(F.max("n").alias("n")).withColumn("h", bucket_of(F.col("conv"), most)).withColumn(
        "base", F.col("conv") - F.col("conv") % span), "convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = saved(convs.join(small(bases), "base", "left").select(
        "conv", "h", "base", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")), "convs")
    own = turns.select("conv", "rank", "sha", "size").join(small(convs), "conv").filter("rank >= h").select(
        "conv", (F.col("rank") + 1 - F.col("h") + F.col("taken")).alias("pos"), "len", "sha", "size")
    heads = turns.filter((F.col("rank") < most) & (F.col("conv") % span == 0)).select(F.col("conv").alias("base"), "rank", "sha", "size")
    heads = heads.join(small(convs), "base").filter("rank < h").select("conv", (F.col("rank") + 1).alias("pos"), "len", "sha", "size")
    roots = convs.select("conv", F.lit(0).cast("long").alias("pos"), "len", F.lit(None).cast("binary").alias("sha"), F.lit(0).cast("long").alias("size"))
    return saved(roots.unionByName(own).unionByName(heads), "sequences")


# -- digests --------------------------------------------------------------------------------------------------


def _xor_runs(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Running XOR of x, begun anew where the key changes."""
    total = np.bitwise_xor.accumulate(x)
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    before = np.where(starts > 0, total[starts - 1], 0)
    return total ^ np.repeat(before, np.diff(np.append(starts, len(key))))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, carry = TaskContext.get().partitionId(), None, [0, 0]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        conv = batch.column("conv").to_numpy()
        digests = [_xor_runs(conv, batch.column(c).to_numpy()) for c in ("x1", "x2")]
        if conv[0] == last:
            same = np.searchsorted(conv, last, side="right")
            for d, c in zip(digests, carry):
                d[:same] ^= c
        last, carry = conv[-1], [d[-1] for d in digests]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, np.int32)), *map(pa.array, digests), *batch.columns], names=["part", *NODE, *batch.schema.names])


def prefixes(sequences: DataFrame, seed: int = 0) -> DataFrame:
    """(conv, pos, len, sha, size, d1, d2, p1, p2): the digests of each prefix and of the one before it."""
    lane = lambda k: F.xxhash64(F.lit(2 * seed + k), "pos", "sha")
    hashed = sequences.withColumns({"x1": lane(0), "x2": lane(1)})
    ranged = hashed.repartitionByRange("conv", "pos").sortWithinPartitions("conv", "pos")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashed.schema)
    ran = saved(ranged.mapInArrow(_running, f"part int, d1 long, d2 long, {fields}"), "prefixes")
    tail = F.max_by(F.struct(*NODE), F.struct("conv", "pos"))
    parts = ran.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), tail.alias("tail")).orderBy("part").collect()
    carried, last, state = [], None, (0, 0)
    for p in parts:  # a row to a partition
        begun = state if p["first"] == last else (0, 0)
        if p["first"] == last:
            carried.append((p["part"], p["first"], *begun))
        alone = p["first"] == p["last"]
        state = tuple(t ^ (b if alone else 0) for t, b in zip(p["tail"], begun))
        last = p["last"]
    carry = sequences.sparkSession.createDataFrame(carried, "part int, conv long, c1 long, c2 long")
    found = ran.join(F.broadcast(carry), ["part", "conv"], "left")
    for k in "12":
        found = found.withColumn(f"d{k}", F.col(f"d{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))))
        found = found.withColumn(f"p{k}", F.col(f"d{k}").bitwiseXOR(F.col(f"x{k}")))
    return found.select("conv", "pos", "len", "sha", "size", *NODE, "p1", "p2")


def _nodes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The nodes, and whether each has one depth, last turn and parent."""
    same = F.lit(True)
    for c in ("pos", "sha", "p1", "p2"):
        same = same & F.min(c).eqNullSafe(F.max(c))
    nodes = saved(rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("pos").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("size").alias("size"), F.sum(F.col("len") - F.col("pos") + 1).alias("turns"), same.alias("same")), "nodes")
    return nodes.drop("same"), nodes.filter("NOT same").isEmpty()


# -- shards ---------------------------------------------------------------------------------------------------


class Slots:
    """Minimal perfect hash of distinct pairs of 64-bit words; each slot holds its pair, so that others are told apart."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, base = [], 0
        left = np.arange(len(a))
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("a digest is repeated")
            at = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        slot = self._slot(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for word, factor in ((b.view(np.uint64), 0xBF58476D1CE4E5B9), (np.uint64(0), 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(31)) ^ word) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, before) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(alone))
            hit = alone[at]
            slot[left[hit]] = before[at[hit]]
            left = left[~hit]
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 for one that is not in the table."""
        slot = self._slot(a, b)
        if len(self.a) == 0:
            return slot
        return np.where((slot >= 0) & (self.a[slot] == a) & (self.b[slot] == b), slot, -1)


_TALLY = "d1 long, d2 long, p1 long, p2 long, conv long, depth long, n_convs long, parent_conv long, n_children long, n_leaves long, saved_tokens long"


def tally(table: pa.Table) -> pa.Table:
    """Children, leaves and saved tokens of the nodes of a shard; the parent's conversation where the parent is in it too."""
    get = {c: table.column(c).to_numpy() for c in ("d1", "d2", "p1", "p2", "conv", "depth", "n_convs", "size")}
    slots, n = Slots(get["d1"], get["d2"]), table.num_rows
    slot = slots.find(get["d1"], get["d2"])
    flat = {}
    for c in ("conv", "depth", "n_convs", "size"):
        flat[c] = np.zeros(n, np.int64)
        flat[c][slot] = get[c]
    parent = np.full(n, -1)
    parent[slot] = slots.find(get["p1"], get["p2"])
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saving = (children == 0).astype(np.int64), (flat["n_convs"] - 1) * flat["size"]
    order = np.argsort(-flat["depth"], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        inside = level[parent[level] >= 0]
        np.add.at(leaves, parent[inside], leaves[inside])
        np.add.at(saving, parent[inside], saving[inside])
    above = parent[slot]
    return pa.table({c: table.column(c) for c in ("d1", "d2", "p1", "p2", "conv", "depth", "n_convs")} | {
        "parent_conv": pa.array(flat["conv"][above], pa.int64(), mask=above < 0), "n_children": pa.array(children[slot]),
        "n_leaves": pa.array(leaves[slot]), "saved_tokens": pa.array(saving[slot])})


# -- the whole trie -------------------------------------------------------------------------------------------


def _ends(rows: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the nodes in which conversations end."""
    ends = saved(rows.filter(F.col("pos") == F.col("len")).select(*NODE, "conv"), "ends")
    ranged = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def records(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def joined(batches):
        def pieces():
            for node, run in itertools.groupby(records(batches), lambda r: r[:2]):
                while piece := [r[2] for r in itertools.islice(run, PIECE)]:
                    yield *node, piece[0], ",".join(map(str, piece))

        found = pieces()
        while part := list(itertools.islice(found, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=[*NODE, "first", "ids"])

    def hashed(batches):
        def digests():
            for node, run in itertools.groupby(records(batches), lambda r: r[:2]):
                sha = hashlib.sha256()
                for k, (*_, ids) in enumerate(run):
                    sha.update(("," if k else "").encode() + ids.encode())
                yield *node, sha.hexdigest()

        found = digests()
        while part := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=[*NODE, "ends_sha256"])

    pieces = ranged.mapInArrow(joined, "d1 long, d2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def _doubled(nodes: DataFrame) -> DataFrame:
    """`nodes(d1, d2, a1, a2, n_leaves, saved_tokens, ...)` with the sums over their subtrees; a1, a2 is the parent, null for the root."""
    while not nodes.filter("a1 IS NOT NULL").isEmpty():
        below = nodes.filter("a1 IS NOT NULL").groupBy("a1", "a2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        below = below.withColumnsRenamed({"a1": "d1", "a2": "d2"})
        above = nodes.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        nodes = nodes.join(below, NODE, "left").join(above, ["a1", "a2"], "left").drop("a1", "a2").withColumnsRenamed({"b1": "a1", "b2": "a2"})
        for c, more in (("n_leaves", "more_leaves"), ("saved_tokens", "more_tokens")):
            nodes = nodes.withColumn(c, F.col(c) + F.coalesce(more, F.lit(0))).drop(more)
        nodes = saved(nodes, "doubled")
    return nodes


def trie(sequences: DataFrame, unit_rows: int = UNIT_ROWS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) over `sequences`.

    conv_id is a node's smallest member; n_leaves and saved_tokens are sums over its subtree, itself included.
    """
    seed, sound = 0, False
    while not sound:  # another seed if two prefixes share a digest
        rows = saved(prefixes(sequences, seed), "rows")
        nodes, sound = _nodes(rows)
        seed += 1
    high = saved(nodes.filter(F.col("turns") > unit_rows), "high")
    keys = small(high.select(*NODE))
    unit = F.min_by(F.struct(*NODE), "pos")
    units = rows.select("conv", "pos", *NODE).join(keys, NODE, "left_anti").groupBy("conv").agg(unit.alias("unit"))
    units = saved(units.withColumnRenamed("conv", "_conv"), "units")
    low = saved(nodes.join(keys, NODE, "left_anti"), "low")
    shards = max(1, -(-low.count() // shard_nodes))
    low = low.join(small(units), F.col("conv") == F.col("_conv")).withColumn("shard", F.pmod(F.xxhash64("unit.d1", "unit.d2"), F.lit(shards)))
    low = low.select("shard", *NODE, "p1", "p2", "conv", "depth", "n_convs", "size")
    low = saved(low.groupBy("shard").applyInArrow(tally, _TALLY), "tallied")

    tops = low.filter("parent_conv IS NULL AND depth > 0").groupBy("p1", "p2").agg(
        F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
    among = high.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("tokens"))
    below = tops.unionByName(among).groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(*[F.sum(c).alias(c) for c in ("n", "leaves", "tokens")])
    none = F.lit(0).cast("long")
    high = high.join(below, NODE, "left").select(
        *NODE, "p1", "p2", "conv", "depth", "n_convs", F.coalesce("n", none).alias("n_children"),
        F.when(F.col("n").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.coalesce("tokens", none) + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
        *[F.when(F.col("depth") > 0, F.col(f"p{k}")).alias(f"a{k}") for k in (1, 2)])
    high = _doubled(saved(high, "doubled")).drop("a1", "a2").withColumn("parent_conv", F.lit(None).cast("long"))
    parents = high.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("over"))
    every = high.unionByName(low).join(small(parents), ["p1", "p2"], "left")
    ends = saved(_ends(rows), "ends")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv", "over"))
    return every.join(ends, NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
