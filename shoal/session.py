"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Upper size of anything shipped to every executor; larger sides take a shuffle.
BROADCAST_BYTES = 256 * 1024 * 1024
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "shoal", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs are designed for; a running session is reused as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. A local temporary one is made only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shoal-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables written between two jobs."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that `scratch_path` named and nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df):
    """Materialise `df` in the shared folder, so that lost executors only cost a re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that starts in here go as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df, name: str):
    """`df` as Parquet in the shared folder: what is read several times, and not always all columns of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables) -> None:
    """Delete tables that `stored` gave and nothing reads any more."""
    for table in tables:
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            discard(table.sparkSession, path)


def spread(df, key: str):
    """Use all cores on an input that is read in fewer partitions than there are cores; else leave it alone.

    Large inputs come in many splits and pass unchanged, so no shuffle is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def computed_once(df, **columns):
    """Add computed columns behind a generator, which filters and projections are not merged into.

    Spark pushes a filter on a computed column below the projection and so repeats its expression in the filter,
    once per reference; for chains of regular expressions that multiplies the work.
    """
    from pyspark.sql import functions as F

    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))
