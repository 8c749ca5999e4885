"""Text to unit vectors: any batch encoder, or hashed TF-IDF built from DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.hashing import leading_bits
from shoal.functions.vectors import list_column, values
from shoal.session import checkpoint, stored

HOT_TERMS = 500_000


def embed(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text",
          id_col: str = "id", batch_size: int = 256) -> DataFrame:
    """(id, vec, error) from a user-supplied encoder; failed rows keep their id, a null vector and the reason.

    `make_encoder` runs once per task and returns a function from texts to a matrix. When a batch fails, its rows
    are tried one by one, so that only the rows at fault are lost. Vectors come out with unit length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for start in range(0, len(texts), batch_size):
                vecs, errors = _encode_batch(encoder, texts[start:start + batch_size])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(vecs)), pa.array(vecs, pa.list_(pa.float64())), pa.array(errors, pa.string())],
                    names=["id", "vec", "error"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        encode, "id long, vec array<double>, error string")


def _encode_batch(encoder, texts: list[str]) -> tuple[list, list]:
    try:
        return [_unit(v) for v in _checked(encoder(texts), len(texts))], [None] * len(texts)
    except Exception as reason:  # any failure of foreign code is recorded, not raised
        if len(texts) == 1:
            return [None], [f"{type(reason).__name__}: {reason}"]
    vecs, errors = [], []
    for text in texts:
        v, e = _encode_batch(encoder, [text])
        vecs += v
        errors += e
    return vecs, errors


def _checked(matrix, rows: int) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    if matrix.ndim != 2 or len(matrix) != rows:
        raise ValueError(f"encoder returned shape {matrix.shape} for {rows} texts")
    return matrix


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


def encoded(embedded: DataFrame) -> DataFrame:
    return embedded.filter(F.col("error").isNull()).select("id", "vec")


def quarantine(embedded: DataFrame) -> DataFrame:
    return embedded.filter(F.col("error").isNotNull()).select("id", "error")


def exploded(df: DataFrame, array_col: str, name: str) -> DataFrame:
    """(id, name): one row per array entry.

    The outer form is used because for the inner one Spark infers a filter on the array's size and pushes it down,
    which would compute the array once more per row, inside every lambda that refers to it.
    """
    return df.select("id", F.explode_outer(array_col).alias(name)).filter(F.col(name).isNotNull())


def term_counts(tokens: DataFrame) -> DataFrame:
    """(id, term, tf) from `tokens(id, words array<string>)`."""
    placed = tokens.repartition("id")
    return exploded(placed, "words", "term").groupBy("id", "term").agg(F.count("*").alias("tf"))


def smooth_idf(df_col, n_docs: int):
    """ln((1 + n) / (1 + df)) + 1"""
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def with_idf(counts: DataFrame, n_docs: int, hot_terms: int = HOT_TERMS, **of_term: Column) -> DataFrame:
    """Add `df`, `idf` and the columns `of_term`, made once for each term, to `counts(id, term, tf)`.

    A common word occurs in most documents, so a plain join on the term would put all its rows in one task. A
    vocabulary of up to `hot_terms` terms is shipped whole; of a larger one the most common `hot_terms` are shipped,
    and only rows of rarer terms are shuffled.
    """
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"))
    per_term = checkpoint(per_term.withColumns({"idf": smooth_idf(F.col("df"), n_docs)} | of_term))
    columns = ["id", "term", "tf", "df", "idf", *of_term]
    if per_term.count() <= hot_terms:
        return counts.join(F.broadcast(per_term), "term").select(*columns)
    hot = per_term.orderBy(F.col("df").desc(), "term").limit(hot_terms)
    with_hot = counts.join(F.broadcast(hot), "term", "left")
    known = with_hot.filter(F.col("idf").isNotNull())
    rare = with_hot.filter(F.col("idf").isNull()).select("id", "term", "tf").join(per_term, "term")
    return known.select(*columns).unionByName(rare.select(*columns))


def hashed_tfidf(tokens: DataFrame, dims: int, n_docs: int | None = None) -> DataFrame:
    """(id, vec): TF-IDF weights added up in `dims` signed hash buckets, unit length; no terms give a zero vector.

    Counts are made once; a task adds up its rows by (id, bucket), so about one row to an id is shuffled after that.
    """
    n_docs = tokens.count() if n_docs is None else n_docs
    digest = F.md5("term")
    bucket = F.pmod(leading_bits(digest), F.lit(dims)).cast("int")
    sign = F.when(F.pmod(leading_bits(F.substring(digest, 9, 8)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    weighted = with_idf(stored(term_counts(tokens), "counts"), n_docs, dim=bucket, sign=sign)
    cells = weighted.filter(F.col("id").isNotNull()).select("id", "dim", (F.col("sign") * F.col("tf") * F.col("idf")).alias("w"))
    id_type = cells.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("id").dictionary_encode()
            key = values(ids.indices).astype(np.int64) * dims + values(batch.column("dim"))
            found, at = np.unique(key, return_inverse=True)
            row, first = np.unique(found // dims, return_index=True)
            sums = pa.array(np.bincount(at, weights=values(batch.column("w"))))
            parts = pa.StructArray.from_arrays([pa.array((found % dims).astype(np.int32)), sums], names=["dim", "w"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)).astype(np.int32)), parts)
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(row)), lists], names=["id", "cells"])

    folded = cells.mapInArrow(fold, f"id {id_type}, cells array<struct<dim:int,w:double>>")
    gathered = folded.groupBy("id").agg(F.flatten(F.collect_list("cells")).alias("cells"))  # a few times `dims` entries
    rows = tokens.select(F.col("id").cast("long").alias("id")).join(gathered, "id", "left")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("cells")
            lengths = np.diff(column.offsets.to_numpy())
            lengths[np.flatnonzero(~values(column.is_valid()).astype(bool))] = 0
            flat = column.flatten()
            at = np.repeat(np.arange(batch.num_rows), lengths) * dims + values(flat.field("dim"))
            dense = np.bincount(at, weights=values(flat.field("w")), minlength=batch.num_rows * dims).astype(np.float64).reshape(-1, dims)  # without cells they are ints
            norm = np.sqrt(np.einsum("ij,ij->i", dense, dense))[:, None]
            dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(dense)], names=["id", "vec"])

    return rows.select("id", "cells").mapInArrow(scatter, "id long, vec array<double>")
