"""Matrices in NumPy's .npy format, read and written by row ranges.

A reader parses the header once and deals ranges of rows to tasks, which read only their bytes: one range of a file in C order, one
for each column of a file in Fortran order. A folder of parts is one matrix, its parts in order of their names.
"""

from __future__ import annotations

import ast
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.vectors import block, list_column
from shoal.operators.ordering import with_row_number
from shoal.session import checkpoint

# Fixed values of the file format.
MAGIC = b"\x93NUMPY"
ALIGN = 64
KINDS = ("f4", "f8")

ROW_BYTES = 32 * 1024 * 1024
_RANGES = "path string, first long, start long, rows long, total long, dims long, data long, kind string, fortran boolean"


@dataclass
class Header:
    rows: int
    dims: int
    kind: str
    fortran: bool
    data: int  # where the numbers begin


def read_header(source) -> Header:
    """The header of an open file; float32 and float64 matrices of one or two dimensions are read, in either byte order."""
    head = source.read(8)
    if head[:6] != MAGIC:
        raise ValueError("not a .npy file")
    width = 2 if head[6] == 1 else 4
    length = int.from_bytes(source.read(width), "little")
    text = source.read(length)
    if len(text) < length:
        raise ValueError("the header of the file is cut off")
    fields = ast.literal_eval(text.decode("latin1" if head[6] < 3 else "utf-8"))
    kind, shape = np.dtype(fields["descr"]), fields["shape"]
    if kind.str[1:] not in KINDS or not 1 <= len(shape) <= 2:
        raise ValueError(f"a matrix of {kind} with {len(shape)} dimensions is not a table of vectors")
    return Header(shape[0], shape[1] if len(shape) == 2 else 1, kind.str, fields["fortran_order"] and len(shape) == 2, 8 + width + length)


def header_bytes(rows: int, dims: int, kind: str) -> bytes:
    text = repr({"descr": kind, "fortran_order": False, "shape": (rows, dims)})
    text += " " * (-(len(MAGIC) + 4 + len(text) + 1) % ALIGN) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin1")


def _files(path: str) -> list[str]:
    """The file itself, or the .npy files of a folder by name."""
    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [path]
    names = sorted(posixpath.basename(f.path) for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".npy"))
    return [posixpath.join(path, n) for n in names]


def _read_range(source, r: dict) -> np.ndarray:
    kind = np.dtype(r["kind"])
    if not r["fortran"]:
        source.seek(r["data"] + r["start"] * r["dims"] * kind.itemsize)
        return np.frombuffer(source.read(r["rows"] * r["dims"] * kind.itemsize), kind).reshape(r["rows"], r["dims"])
    out = np.empty((r["rows"], r["dims"]), kind)
    for d in range(r["dims"]):
        source.seek(r["data"] + (d * r["total"] + r["start"]) * kind.itemsize)
        out[:, d] = np.frombuffer(source.read(r["rows"] * kind.itemsize), kind)
    return out


def read_npy(spark: SparkSession, path: str, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, vec) of a matrix, or of the parts in a folder; the id is the row's number in the whole matrix, from 0."""
    ranges, first = [], 0
    for name in _files(path):  # a header to a file
        system, file = fs.FileSystem.from_uri(name)
        with system.open_input_file(file) as source:
            h = read_header(source)
        step = max(1, row_bytes // (max(h.dims, 1) * np.dtype(h.kind).itemsize))
        ranges += [(name, first, s, min(step, h.rows - s), h.rows, h.dims, h.data, h.kind, h.fortran) for s in range(0, h.rows, step)]
        first += h.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, file = fs.FileSystem.from_uri(r["path"])
                with system.open_input_file(file) as source:
                    x = _read_range(source, r).astype(np.float64)
                ids = np.arange(r["first"] + r["start"], r["first"] + r["start"] + r["rows"])
                for k in range(0, len(x), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k:k + 8192]), list_column(x[k:k + 8192])], names=["id", "vec"])

    table = spark.createDataFrame(ranges, _RANGES).repartition(max(1, len(ranges)), "path", "start")
    return table.mapInArrow(run, "id long, vec array<double>")


def write_npy(vectors: DataFrame, folder: str, kind: str = "f4") -> DataFrame:
    """Write `vectors(id, vec)` in order of id as parts of one matrix; returns (part, path, first_row, rows).

    A part appears under its name only once it is whole, so a task that runs again replaces it.
    """
    if kind not in KINDS:
        raise ValueError(f"choose one of {KINDS}")
    numbered = with_row_number(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), ["id"])
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    per_part = max(1, ROW_BYTES // (8 * max(1, numbered.agg(F.max(F.size("vec"))).first()[0] or 1)))
    total = numbered.count()
    placed = numbered.withColumn("part", F.floor((F.col("rn") - 1) / per_part)).repartition("part").sortWithinPartitions("part", "rn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, rows = None, None, 0

        def closed():
            out.close()
            path = posixpath.join(root, f"part-{part:08d}.npy")
            system.move(hidden, path)
            return pa.RecordBatch.from_pydict({"part": [part], "path": [posixpath.join(folder, f"part-{part:08d}.npy")], "first_row": [part * per_part], "rows": [rows]})

        for batch in batches:
            numbers = batch.column("part").to_numpy()
            x = block(batch.column("vec")).astype(f"<{kind}")
            for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if len(at) == 0:
                    continue
                if numbers[at[0]] != part:
                    if out is not None:
                        yield closed()
                    part, rows = int(numbers[at[0]]), 0
                    hidden = posixpath.join(root, f".part-{part:08d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}")
                    out = system.open_output_stream(hidden, compression=None)
                    out.write(header_bytes(min(per_part, total - part * per_part), x.shape[1], f"<{kind}"))
                out.write(np.ascontiguousarray(x[at]).tobytes())
                rows += len(at)
        if out is not None:
            yield closed()

    return checkpoint(placed.select("part", "vec").mapInArrow(run, "part long, path string, first_row long, rows long"))
