"""Session defaults and the reliable cut points used by multi-step operators."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "ledgerlens", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small files on one machine: row groups and splits small enough to occupy every core.
        .config("spark.hadoop.parquet.block.size", str(2 << 20))
        .config("spark.sql.files.openCostInBytes", str(256 << 10))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def split_hot_keys(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split a hot key of a join even where a later step relied on its partitioning."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


ROWS_PER_TASK = 500_000
_TASK_SETTINGS = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                  "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def bounded_tasks(spark: SparkSession, rows: int, steps: int = 1) -> SparkSession:
    """Let scans and shuffles of `rows` rows have tasks of some `ROWS_PER_TASK` rows, however many rows there are.

    Spark cuts by compressed bytes. A sale takes 30 of them, but two entries of 300 bytes in the hash table of
    a distinct count, so a usual split of 128 MB spills. Tables to be cut so must be written with as many rows per file.
    A task that holds rows for several `steps` at once, as a join and the sums over it, gets so many times fewer.
    """
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows * steps / ROWS_PER_TASK))
    shuffled = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.files.minPartitionNum", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffled))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{16 // steps}m")
    return spark


@contextmanager
def own_tasks(spark: SparkSession) -> Iterator[None]:
    """Undo what `bounded_tasks` sets within the block, for small tables made from many rows and read after it.

    The frames of the rows must be run within the block.
    """
    before = {name: spark.conf.get(name, None) for name in _TASK_SETTINGS}
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master, where every task sees the same disk, may fall back to a
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return sc.getCheckpointDir()


def durable_folder(spark: SparkSession) -> str:
    """Where fitted models outlive a session: the configured shared folder.

    Only a local master may fall back to a folder of its own, the same in every session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"ledgerlens-durable-{os.getuid()}")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Run `df` once into Parquet below the shared folder and continue from those files.

    The files outlive lost executors, and later steps read only the columns they use. `rows_per_file` is the
    most rows of a file (0: any number).
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
