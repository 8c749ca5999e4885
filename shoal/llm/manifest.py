"""Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

A row's leaf is the hash of its fields, each written with its length. The leaves of a group (a source) stand in order of their
id; `FANOUT` consecutive nodes become their hash until one is left, the group's subroot; the subroots, in order of their group,
become the root in the same way.

A tree is cut into aligned blocks of `LEVELS` hash levels, so that a block stands over up to FANOUT ** LEVELS consecutive nodes.
The digests of a block lie in one array in van Emde Boas layout: the subtree is split at half its height, the upper part comes
first, then the lower parts from left to right, each laid out in the same way. `address` computes a node's place from its depth
and index; construction writes by it and `siblings` reads by it, a run of siblings at a time. The roots of the blocks are the
feet of blocks of the next tier, and so on up.

Leaves are numbered by one range shuffle and counts of (partition, group), so that a group with a third of the rows is spread
like others. A block of at most FANOUT ** LEVELS digests is what a task holds at a time; rows are streamed past it in order.
Proofs go down the tiers: a block gets the siblings on the way from its root to the top, and adds its own.

Nulls: a null field is written as `-`; a null group comes first, a null id stands before others. Rows that repeat an id stand in
order of their leaves, and rows that repeat altogether have a leaf each. A table without rows gives no rows. Other columns
are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.scratch import ranked, saved, small

FANOUT = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64  # characters of a digest


def leaf(*fields: Column) -> Column:
    """Hash of the fields, each as its UTF-8 length, a colon and its text, or `-` if it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# -- layout ---------------------------------------------------------------------------------------------------


def span(height: int) -> int:
    """Nodes of a whole subtree with so many levels of nodes."""
    return (FANOUT ** height - 1) // (FANOUT - 1)


def address(height: int, depth: int, index):
    """Place of the node (or array of nodes) `index` at `depth` in a subtree with `height` levels of nodes."""
    at = 0
    while height > 1:
        upper = height // 2
        if depth < upper:
            height = upper
            continue
        step = FANOUT ** (depth - upper)
        at = at + span(upper) + index // step * span(height - upper)
        index, depth, height = index % step, depth - upper, height - upper
    return at


def levels_over(nodes: int) -> int:
    """Hash levels over so many nodes until one is left."""
    levels = 0
    while FANOUT ** levels < nodes:
        levels += 1
    return levels


def widths(feet: int, levels: int) -> list[int]:
    """Nodes at each depth of a block, from its root down."""
    out = [feet]
    for _ in range(levels):
        out.append(-(-out[-1] // FANOUT))
    return out[::-1]


def built(feet: list[bytes], levels: int) -> bytes:
    """The block over these digests; places of nodes that the last runs lack stay zero or are cut off at the end."""
    counts = widths(len(feet), levels)
    size = 1 + max(address(levels + 1, depth, n - 1) for depth, n in enumerate(counts))
    layout = np.zeros((size, 32), np.uint8)
    row = feet
    for depth in range(levels, -1, -1):
        layout[address(levels + 1, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        text = b"".join(row).hex()
        run = _HEX * FANOUT
        row = [hashlib.sha256(text[k:k + run].encode()).digest() for k in range(0, len(text), run)]
    return layout.tobytes()


class Block:
    """A stored block; runs of siblings that were read last are kept, as feet come in order."""

    def __init__(self, layout: bytes, feet: int, levels: int, path: list[str]):
        self.nodes = np.frombuffer(layout, np.uint8).reshape(-1, 32)
        self.counts, self.levels, self.path = widths(feet, levels), levels, path
        self.last: list[tuple[int, str]] = [(-1, "")] * (levels + 1)

    def siblings(self, foot: int) -> list[str]:
        """Hex of the siblings before and after a foot, then of those of each node above it, up to the top of the tree."""
        out = []
        for depth in range(self.levels, 0, -1):
            number, place = divmod(foot, FANOUT)
            if self.last[depth][0] != number:
                run = np.arange(number * FANOUT, min((number + 1) * FANOUT, self.counts[depth]))
                self.last[depth] = number, self.nodes[address(self.levels + 1, depth, run)].tobytes().hex()
            text = self.last[depth][1]
            out += [text[:_HEX * place], text[_HEX * (place + 1):]]
            foot = number
        return out + self.path


def folded(digest: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for before, after in zip(path[::2], path[1::2]):
        digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
    return digest


# -- jobs -----------------------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """`rows` (key, rank, n, id, leaf, checked), the tiers of blocks of all groups, the groups (key, rank) and the tiers over them, the root."""

    rows: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    root: str | None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, n)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


_BLOCK = pa.schema([("key", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("feet", pa.int32()), ("levels", pa.int32()),
                    ("layout", pa.binary()), ("root", pa.binary())])
_PATH = pa.schema([("key", pa.string()), ("rank", pa.int64()), ("path", pa.list_(pa.string()))])
_PROOF = pa.schema([("key", pa.string()), ("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                    ("proof_sha256", pa.string()), ("folded_root", pa.string())])
_SQL_BLOCK = "key string, block long, n long, feet int, levels int, layout binary, root binary"


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Blocks over `nodes(key, rank, n, digest)`, then over the blocks' roots where a key has several, and so on."""
    width = FANOUT ** levels

    def build(batches):
        def blocks():
            for (key, block), run in itertools.groupby(_records(batches), lambda r: r[:2]):
                run = list(run)
                n = run[0][3]
                own = levels if n > width else levels_over(n)
                layout = built([r[4] for r in run], own)
                root = address(own + 1, 0, 0)
                yield key, block, n, len(run), own, layout, layout[32 * root:32 * root + 32]

        return _batches(blocks(), _BLOCK, 32)

    out = []
    while True:
        feet = nodes.select("key", F.floor(F.col("rank") / width).alias("block"), "rank", "n", "digest")
        feet = feet.repartition("key", "block").sortWithinPartitions("key", "block", "rank")
        out.append(saved(feet.mapInArrow(build, _SQL_BLOCK), "blocks"))
        open_keys = out[-1].filter(F.col("n") > width)
        if open_keys.isEmpty():
            return out
        nodes = open_keys.select("key", F.col("block").alias("rank"), F.ceil(F.col("n") / width).alias("n"), F.col("root").alias("digest"))


def _roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(key, root): of each key's only block in its last tier."""
    width, out = FANOUT ** levels, None
    for tier in tiers:
        last = tier.filter(F.col("n") <= width).select("key", "root")
        out = out.unionByName(last) if out else last
    return out


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", doc_id: str = "doc_id", checked: Column | None = None,
             levels: int = LEVELS) -> Manifest:
    """Leaves and blocks of `docs`. `checked` is the leaf that a copy of the row has, if it is not the same (null: the same)."""
    key = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = saved(docs.select(
        key.alias("key"), F.col(doc_id).cast("long").alias("id"), F.unhex(leaf(*map(F.col, fields))).alias("leaf"),
        F.unhex(checked if checked is not None else F.lit(None).cast("string")).alias("checked"),
        F.monotonically_increasing_id().alias("line")), "leaves")
    rows = ranked(leaves, ["key"], ["id", "leaf", "line"])
    tiers = _tiers(rows.select("key", "rank", "n", F.col("leaf").alias("digest")), levels)
    groups = ranked(saved(_roots(tiers, levels), "subroots").withColumn("all", F.lit("")), ["all"], ["key"])
    upper = _tiers(groups.select(F.col("all").alias("key"), "rank", "n", F.col("root").alias("digest")), levels)
    top = _roots(upper, levels).first()
    return Manifest(rows, tiers, groups, upper, bytes(top["root"]).hex() if top else None)


def _paths(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(key, rank, path) of every foot of the blocks, whose own paths are `above(key, rank, path)`."""
    width = FANOUT ** levels

    def run(batches):
        def paths():
            for key, number, feet, own, layout, path in _records(batches):
                block = Block(layout, feet, own, path)
                for foot in range(feet):
                    yield key, number * width + foot, block.siblings(foot)

        return _batches(paths(), _PATH, 1024)

    rows = _with_path(blocks, above).select("key", "block", "feet", "levels", "layout", "path")
    return saved(rows.mapInArrow(run, "key string, rank long, path array<string>"), "paths")


def _with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("key").alias("_key"), F.col("rank").alias("_rank"), "path")
    return blocks.join(small(above, 10_000), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_rank"))).drop("_key", "_rank")


def _down(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The paths (key, rank, path) of the blocks of the first tier; `above` holds those of each key's only block in its last tier."""
    found = above
    for tier in tiers[:0:-1]:  # a key has one block in its last tier, and none in those above it
        found = _paths(tier, found, levels).unionByName(above)
    return found


def proofs(made: Manifest, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `proof_sha256` is the hash of all siblings on the way to the root. `folded_root` follows from the checked leaf and these siblings,
    and `verified` says whether it is the root.
    """
    spark = made.rows.sparkSession
    start = spark.createDataFrame([("", 0, [])], "key string, rank long, path array<string>")
    tops = _paths(made.upper[0], _down(made.upper, start, levels), levels)
    tops = made.groups.select(F.col("key"), F.col("rank"), F.col("root").alias("subroot")).join(
        small(tops.select("rank", "path"), 10_000), "rank").select("key", F.lit(0).cast("long").alias("rank"), "path", "subroot")
    tops = saved(tops, "tops")
    blocks = _with_path(made.tiers[0], _down(made.tiers, tops.select("key", "rank", "path"), levels))
    subroots = tops.select(F.col("key").alias("_key"), "subroot")
    blocks = blocks.join(small(subroots), F.col("key") == F.col("_key")).select(
        "key", "block", F.lit(-1).cast("long").alias("rank"), "feet", "levels", "layout", "path", "subroot",
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("checked"))
    width, root = FANOUT ** levels, made.root
    rows = made.rows.select(
        "key", F.floor(F.col("rank") / width).alias("block"), "rank", F.lit(None).cast("int").alias("feet"), F.lit(None).cast("int").alias("levels"),
        F.lit(None).cast("binary").alias("layout"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("binary").alias("subroot"),
        "id", "leaf", "checked")
    both = blocks.unionByName(rows).repartition("key", "block").sortWithinPartitions("key", "block", "rank")

    def run(batches):
        def proved():
            block = subroot = None
            for key, number, rank, feet, height, layout, path, top, i, own, checked in _records(batches):
                if rank < 0:  # the block comes before its rows
                    block, subroot = Block(layout, feet, height, path), top.hex()
                    continue
                way = block.siblings(rank - number * width)
                proof = hashlib.sha256("".join(way).encode()).hexdigest()
                yield key, i, own.hex(), subroot, root, proof, folded((checked or own).hex(), way)

        return _batches(proved(), _PROOF, 4096)

    found = both.mapInArrow(run, "key string, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.drop("key").withColumn("verified", F.col("folded_root") == F.col("root"))
