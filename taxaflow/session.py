"""Session set-up and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Applied only where the session has no value of its own.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "taxaflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="taxaflow-"))
    return context.getCheckpointDir()


def pin_file_splits(spark: SparkSession) -> None:
    """Keep file splits the same while executors come and go.

    Without a set number Spark derives the split size from the cores that are up at the moment.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark).rstrip('/')}/taxaflow/{name}-{uuid.uuid4().hex}"


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run, not when the driver happens to collect its garbage.

    For writes and counts of frames that are not run again as they are: a frame that is would shuffle again.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def staged(df: DataFrame, name: str = "staged", path: str | None = None) -> DataFrame:
    """The rows as compressed Parquet in the shared folder: like ``settle``, for wide rows that a checkpoint keeps as they are in memory.

    Also for small tables that are read again and again: a checkpoint is read by as many tasks as wrote it, with
    shuffle files of each, while small Parquet files share a task and a table of known small size is broadcast.
    """
    path = path or new_shared_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def briefly_staged(df: DataFrame) -> Iterator[DataFrame]:
    """``staged`` rows for what is done with them at the end of the block, where their folder goes."""
    spark, path = df.sparkSession, new_shared_path(df.sparkSession, "staged")
    try:
        yield staged(df, path=path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later uses read the same rows even after executors were lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
