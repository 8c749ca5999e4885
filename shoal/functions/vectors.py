"""Vector columns and Arrow blocks. Tables carry `array<double>`; ML vectors exist only at MLlib edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(col: Column) -> Column:
    return col.cast("array<double>")


def l2_norm(col: Column) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def normalise(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows of unit length; zero rows stay zero."""
    ml = df.withColumn(vec, array_to_vector(as_double(F.col(vec))))
    unit = Normalizer(p=2.0, inputCol=vec, outputCol="_unit").transform(ml)
    return unit.withColumn(vec, vector_to_array("_unit")).drop("_unit")


def block(column) -> np.ndarray:
    """An Arrow list column as a dense matrix, one row per list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    if len(column) == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(column), -1)


def values(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return column.to_numpy()
    return column.to_numpy(zero_copy_only=False)


def list_column(matrix: np.ndarray) -> pa.Array:
    """A dense matrix as an Arrow list column."""
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def packed_column(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes, which Spark hands to Python and back without looking into them."""
    rows, width = matrix.shape
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """The matrix whose rows `packed_column` made."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return np.frombuffer(data.tobytes() if offsets[0] % np.dtype(kind).itemsize else data, kind).reshape(len(column), -1)


def bytes_column(offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The lists in `flat` that `offsets` cut, each as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def bytes_lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and numbers of the lists that `bytes_column` packed."""
    size = np.dtype(kind).itemsize
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].tobytes() if data is not None else b""
    return (offsets - offsets[0]) // size, np.frombuffer(flat, kind)


def steps(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Each number of the lists less the one before it in its list, which is small where lists ascend."""
    out = np.diff(flat, prepend=flat[:1] * 0).astype(flat.dtype)
    first = offsets[:-1][np.diff(offsets) > 0]
    out[first] = flat[first]
    return out


def unstepped(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The lists of which `flat` holds the `steps`."""
    total = np.cumsum(flat, dtype=np.int64)
    before = np.append(0, total)[offsets[:-1]]
    return (total - np.repeat(before, np.diff(offsets))).astype(flat.dtype)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared Euclidean distances between two blocks by one matrix product."""
    out = a @ b.T
    out *= -2.0
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(out, 0.0, out=out)
