"""Readers and writers for files, and the partitioned assignment table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.sources import schemas
from shoal.sources.json_arrays import read_array

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_corpus(spark: SparkSession, path: str, lines: bool = False, array: bool = False) -> DataFrame:
    """Question objects from JSON: one object per line (`lines`), or whole-file arrays.

    With `array` an array is read by many tasks; without either, a file is parsed by one, which small ones take less time for.
    """
    if array:
        return read_array(spark, path, schemas.CORPUS)
    return spark.read.schema(schemas.CORPUS).json(path, multiLine=not lines)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One JSON object per line."""
    corpus.write.json(path)


def read_vectors(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id long, vec array<double>) from parquet; only the two columns are read."""
    return spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def write_vectors(vectors: DataFrame, path: str, mode: str = "error") -> None:
    vectors.select("id", "vec").write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and doubled quotes; titles may hold commas, quotes and line breaks."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.METADATA)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode).options(header=True, quote='"', escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


class AssignmentStore:
    """`assignments(question_id, k, variant, cluster_id)` as parquet, one folder per (k, variant)."""

    SCHEMA = "question_id long, cluster_id int, k int, variant string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, assignments: DataFrame) -> None:
        """Replace exactly the (k, variant) partitions that `assignments` holds."""
        columns = assignments.select(
            F.col("question_id").cast("long"), F.col("cluster_id").cast("int"), F.col("k").cast("int"), "variant")
        columns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "k", "variant").parquet(self.path)

    def read(self, k: int | None = None, variant: str | None = None, required: bool = False) -> DataFrame:
        """Rows of the chosen partitions. An absent one gives no rows, or an error if `required`."""
        table = self.spark.read.schema(self.SCHEMA).parquet(self.path).select("question_id", "k", "variant", "cluster_id")
        if k is not None:
            table = table.filter(F.col("k") == k)
        if variant is not None:
            table = table.filter(F.col("variant") == variant)
        if required and table.isEmpty():
            raise FileNotFoundError(f"no labels for k={k}, variant={variant} in {self.path}")
        return table

    def labelings(self) -> DataFrame:
        """(k, variant) of the partitions present."""
        return self.read().select("k", "variant").distinct()


class SearchLog:
    """Append-only table of K-search results."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, search: DataFrame) -> None:
        search.select("k", "dbi", "inertia", "seconds", "is_new_best").coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(schemas.SEARCH).parquet(self.path)

    def read_if_any(self) -> DataFrame:
        """The log, or no rows if nothing has been written to it yet."""
        try:
            return self.read()
        except AnalysisException:
            return self.spark.createDataFrame([], schemas.SEARCH)

    def lines(self) -> DataFrame:
        """(k, line): the log as text, one line per fit, with a mark on every new best K."""
        return render_search(self.read())


def render_search(search: DataFrame) -> DataFrame:
    """(k, line) of `search(k, dbi, inertia, seconds, is_new_best)`."""
    line = F.format_string("[K=%d] DBI=%.4f, Inertia=%.2f, Time=%.2fs", "k", "dbi", "inertia", "seconds")
    mark = F.when(F.col("is_new_best"), F.format_string("\n   --> New Best K: %d", "k")).otherwise(F.lit(""))
    return search.select("k", F.concat(line, mark).alias("line"))


def parse_search(text: DataFrame) -> DataFrame:
    """(k, dbi, inertia, seconds) from the fit lines of a text log `text(value)`."""
    number = r"([-+0-9.eE]+)"
    pattern = rf"^\[K=(\d+)\] DBI={number}, Inertia={number}, Time={number}s"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return text.filter(F.col("value").rlike(pattern)).select(
        part(1).cast("int").alias("k"), part(2).cast("double").alias("dbi"),
        part(3).cast("double").alias("inertia"), part(4).cast("double").alias("seconds"))
