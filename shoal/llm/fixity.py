"""WARC archives and a fixity audit of their replicas by Merkle trees.

`write_archive` writes a table of pages as WARC 1.1 files, a record to a page, each record a gzip member of its own;
`replicate` copies an archive file by file. `leaves` reads an archive as a stream, one task to a file, and hashes the stored bytes of each
record; a member that cannot be unpacked is a damaged record, which ends where the next record begins (neighbours whose beginnings are damaged
too are one with it). `audit` builds a tree over the records of each file, `FANOUT` children to a node: a node hashes the lengths and hashes of
its children in order. It compares the roots of two replicas, then the children of nodes that differ, and so on down to the records; branches
that agree are left alone. Records that are found elsewhere in the file are then matched by hash, so one that is lost in the middle does not
make the later ones differ. Offsets count the stored, compressed bytes of a file.

What is shuffled are hashes: 32 bytes and a few numbers for a record. No file, tree or group of records is held in one place;
a node has at most `FANOUT` children.

Null pages are records without a payload; null ids and urls are written as empty and come back null. Rows that repeat are
records of their own. An archive of no pages has no files, and its audit no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.scratch import saved

FANOUT = 16
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 14
MAX_HEAD = 1 << 20
_MAGIC = b"\x1f\x8b\x08"


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: text/html",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def unpacked(stored: bytes) -> bytes | None:
    """The bytes of one whole gzip member, or None if it is damaged."""
    unpack = zlib.decompressobj(31)
    try:
        data = unpack.decompress(stored)
    except zlib.error:
        return None
    return data if unpack.eof and not unpack.unused_data else None


class _File:
    """A file under a name of its own until it is closed, so that a task that runs again replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.part, self.path = posixpath.join(root, f".{name}-{uuid.uuid4().hex}"), posixpath.join(root, name)
        self.out = self.system.open_output_stream(self.part, compression=None)

    def add(self, data: bytes) -> None:
        self.add_stored(packed(data))

    def add_stored(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


class _Window:
    """The bytes of a file from the member that is being read."""

    def __init__(self, source):
        self.source, self.data = source, bytearray()

    def more(self) -> bool:
        got = self.source.read(READ_BYTES)
        self.data += got
        return bool(got)

    def member(self) -> tuple[int, bytes | None]:
        """Length and content of the member at the start; (0, None) if it cannot be unpacked."""
        unpack, parts, at = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if at == len(self.data) and not self.more():
                    return 0, None
                with memoryview(self.data) as view, view[at:at + FEED_BYTES] as fed:
                    parts.append(unpack.decompress(fed))
                    at += len(fed) - len(unpack.unused_data)
        except zlib.error:
            return 0, None
        return at, b"".join(parts)

    def next_record(self) -> int:
        """Where the next member begins whose content begins like a record, or the end of the file."""
        at = 1
        while True:
            at = self.data.find(_MAGIC, at)
            if at < 0:
                at = max(1, len(self.data) - len(_MAGIC) + 1)
                if not self.more():
                    return len(self.data)
                continue
            while len(self.data) < at + 512 and self.more():
                pass
            try:
                if zlib.decompressobj(31).decompress(bytes(self.data[at:at + 512]), 5) == b"WARC/":
                    return at
            except zlib.error:
                pass
            at += 1


def read_members(path: str) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(offset, stored bytes, record) of each member; the record is None where the stored bytes cannot be unpacked."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as source:
        window, offset = _Window(source), 0
        while window.data or window.more():
            length, whole = window.member()
            if whole is None:
                length = window.next_record()
            stored = bytes(window.data[:length])
            del window.data[:length]
            yield offset, stored, whole
            offset += length


def fields_of(whole: bytes) -> dict[str, str]:
    head = whole[:max(0, whole.find(b"\r\n\r\n"))][:MAX_HEAD].decode("utf-8", "replace")
    return dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)


def read_records(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset among the records' bytes, header fields, whole record) of each record that can be read; a record is in memory at a time."""
    offset = 0
    for _, _, whole in read_members(path):
        if whole is not None:
            yield offset, fields_of(whole), whole
            offset += len(whole)


def payload_of(whole: bytes, fields: dict[str, str]) -> bytes:
    at = whole.find(b"\r\n\r\n") + 4
    size = fields.get("Content-Length", "")
    return whole[at:at + int(size)] if re.fullmatch("[0-9]{1,18}", size) else whole[at:]


def write_archive(pages: DataFrame, folder: str, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Write the pages, a file to a partition as it is read; returns (file, path, n_records)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches):
        out, n, name = None, 0, f"pages-{TaskContext.get().partitionId():08d}.warc.gz"
        for batch in batches:
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                out = out or _File(folder, name)
                out.add(record(i, u, (h or "").encode("utf-8")))
                n += 1
        if out:
            out.close()
            yield _named(folder, name, n)

    return saved(rows.mapInArrow(run, "file string, path string, n_records long"), "archive")


def _named(folder: str, name: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "path": [posixpath.join(folder, name)], "n_records": pa.array([n], pa.int64())})


def replicate(files: DataFrame, folder: str, change=None, change_stored=None) -> DataFrame:
    """Copy an archive to `folder`, member by member as stored.

    For a drill, `change(page id, record)` may return other bytes for a record, and `change_stored(page id, stored bytes)` for its gzip member.
    """
    rows = files.select("file", "path").repartition(max(1, files.count()), "file")

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
                out, n = _File(folder, name), 0
                for _, stored, whole in read_members(path):
                    if whole is not None and (change or change_stored):
                        page_id = page_of(fields_of(whole))
                        other = change(page_id, whole) if change else whole
                        stored = stored if other == whole else packed(other)
                        stored = change_stored(page_id, stored) if change_stored else stored
                    out.add_stored(stored)
                    n += 1
                out.close()
                yield _named(folder, name, n)

    return saved(rows.mapInArrow(run, "file string, path string, n_records long"), "replica")


def page_of(fields: dict[str, str]) -> int | None:
    name = fields.get("WARC-Record-ID", "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if re.fullmatch("-?[0-9]{1,19}", name) and -(1 << 63) <= int(name) < 1 << 63 else None


def leaves(files: DataFrame) -> DataFrame:
    """(file, number, start, end, hash, page_id, payload_sha256, payload_bytes, sound) of each record.

    `hash`, `start` and `end` are those of the stored bytes. `sound` says whether they can be unpacked and the payload has the digest that
    its header names; page and payload of a record that cannot be unpacked are null. Numbers run from 0 in each file.
    """
    schema = ("file string, number long, start long, end long, hash string, page_id long, payload_sha256 string,"
              " payload_bytes long, sound boolean")
    rows = files.select("file", "path").repartition(max(1, files.count()), "file")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
                out = []
                for k, (offset, stored, whole) in enumerate(read_members(path)):
                    row = (name, k, offset, offset + len(stored), hashlib.sha256(stored).hexdigest())
                    if whole is None:
                        out.append((*row, None, None, None, False))
                    else:
                        fields = fields_of(whole)
                        payload = payload_of(whole, fields)
                        digest = hashlib.sha256(payload).hexdigest()
                        out.append((*row, page_of(fields), digest, len(payload), fields.get("WARC-Payload-Digest") == f"sha256:{digest}"))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return saved(rows.mapInArrow(run, schema), "leaves")


def levels(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels (file, number, start, end, hash) of the trees over `records`, from the records to one root for each file."""
    out = [records.select("file", "number", "start", "end", "hash")]
    widest = records.agg(F.max("number")).first()[0] or 0
    while widest > 0 or len(out) == 1:
        child = F.struct("number", "start", "end", "hash")
        nodes = out[-1].groupBy("file", F.floor(F.col("number") / fanout).alias("above")).agg(F.array_sort(F.collect_list(child)).alias("below"))
        text = F.array_join(F.transform("below", lambda c: F.concat_ws(":", c["end"] - c["start"], c["hash"])), ",")
        out.append(saved(nodes.select(
            "file", F.col("above").alias("number"), F.array_min("below.start").alias("start"), F.array_max("below.end").alias("end"),
            F.sha2(text.cast("binary"), 256).alias("hash")), "nodes"))
        widest //= fanout
    return out


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two archives' `leaves`: (file, number, problem, start, end, page_id, ...).

    problem: changed, missing (only ours has it) or extra. `damaged` names the side whose record does not have the digest of its
    header, if one does not.
    """
    a, b = levels(ours, fanout), levels(theirs, fanout)
    tall = max(len(a), len(b))
    for tree in (a, b):  # a file that lost records may have a lower tree; its root then stands in the levels above too
        while len(tree) < tall:
            tree.append(tree[-1])
    differ = _unlike(a[-1], b[-1])
    for below, other in zip(a[-2::-1], b[-2::-1]):
        differ = saved(differ, "differ")
        inside = [side.withColumn("above", F.floor(F.col("number") / fanout)).join(
            differ.withColumnRenamed("number", "above"), ["file", "above"], "left_semi").drop("above") for side in (below, other)]
        differ = _unlike(*inside)
    differ = saved(differ, "differ")
    ours, theirs = (saved(side.join(differ, ["file", "number"], "left_semi"), "side") for side in (ours, theirs))
    alone = []
    for name, side, other in (("a", ours, theirs), ("b", theirs, ours)):
        columns = ("number", "start", "end", "page_id", "payload_sha256", "payload_bytes", "sound")
        alone.append(_placed(_unmatched(side, other)).select(
            "file", "gap", "turn", *[F.col(c).alias(f"{c}_{name}") for c in columns]))
    found = alone[0].join(alone[1], ["file", "gap", "turn"], "full")
    problem = F.when(F.col("start_b").isNull(), "missing").when(F.col("start_a").isNull(), "extra").otherwise("changed")
    damaged = F.when(~F.col("sound_b"), F.when(~F.col("sound_a"), "both").otherwise("theirs")).when(~F.col("sound_a"), "ours")
    return found.select(
        "file", F.coalesce("number_a", "number_b").alias("number"), problem.alias("problem"), F.coalesce("start_a", "start_b").alias("start"),
        F.coalesce("end_a", "end_b").alias("end"), F.coalesce("page_id_a", "page_id_b").alias("page_id"),
        F.coalesce("payload_sha256_a", "payload_sha256_b").alias("payload_sha256"),
        F.coalesce("payload_bytes_a", "payload_bytes_b").alias("payload_bytes"), damaged.alias("damaged"))


def _unmatched(side: DataFrame, other: DataFrame) -> DataFrame:
    """Records of `side` whose stored bytes `other` does not hold as often in the same file; the first ones count as matched."""
    own, there = (s.groupBy("file", "hash").agg(F.count("*").alias(n)) for s, n in ((side, "own"), (other, "there")))
    more = own.join(there, ["file", "hash"], "left").select("file", "hash", F.coalesce("there", F.lit(0)).alias("there"), "own").filter("own > there")
    turn = F.row_number().over(Window.partitionBy("file", "hash").orderBy("number"))
    return side.join(more.select("file", "hash", "there"), ["file", "hash"]).withColumn("turn", turn).filter("turn > there").drop("there", "turn")


def _placed(alone: DataFrame) -> DataFrame:
    """`gap`, how many matched records of the file come before, and `turn`, the place among the records between the same two matched ones."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("number"))
    placed = alone.withColumn("gap", F.col("number") - rank)
    return placed.withColumn("turn", F.row_number().over(Window.partitionBy("file", "gap").orderBy("number")))


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, number) of nodes that the two sides do not share."""
    both = a.select("file", "number", F.col("hash").alias("hash_a")).join(
        b.select("file", "number", F.col("hash").alias("hash_b")), ["file", "number"], "full")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "number")
