"""Sensor runs: a folder of text files, one file per time step, one column per sensor.

A step of few numbers is a poor file: listing, opening and renaming it cost more than its content, and the
driver does much of that. Runs of many short steps are therefore packed: text files of any size whose
lines name the step they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.calendar import timestamp_from_name
from ledgerlens.functions.coerce import null_if_nan
from ledgerlens.functions.statistics import signal_statistics
from ledgerlens.operators.ordered import POSITION, with_position

MAX_SENSORS = 4


def scan_signal_files(spark: SparkSession, path: str, max_sensors: int | None = None, levels: int = 1) -> DataFrame:
    """(folder, file_name, sensor, value), one row per number; sensors count from 1.

    `path` may be one run folder or a pattern for many; `folder` is the name of the file's own. With
    `levels` 2 a time step is a folder of part files, named by that folder.
    """
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - levels).alias("folder"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -levels).alias("file_name"),
        (cells if max_sensors is None else F.slice(cells, 1, max_sensors)).alias("_cells"),
    )
    return _numbers(lines)


def sink_packed_signals(df: DataFrame, path: str, folder_col: str, file_col: str, value_cols: Sequence[str]) -> None:
    """Write lines of numbers as `folder/file_name`, a tab, and the numbers; as many files as `df` has partitions.

    Names hold no slash, tab or line break. A missing name is empty, a missing number `nan`.
    """
    name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (folder_col, file_col)])
    cells = F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in value_cols])
    df.select(F.concat_ws("\t", name, cells).alias("value")).write.text(path)


def scan_packed_signals(spark: SparkSession, path: str, max_sensors: int | None = None) -> DataFrame:
    """`scan_signal_files` of what `sink_packed_signals` wrote; empty names are null."""
    name, cells = F.split("value", "\t", 2)[0], F.split(F.trim(F.split("value", "\t", 2)[1]), r"\s+")
    lines = spark.read.text(path).where(F.contains("value", F.lit("\t")))
    return _numbers(lines.select(
        F.nullif(F.substring_index(name, "/", 1), F.lit("")).alias("folder"),
        F.nullif(F.substring_index(name, "/", -1), F.lit("")).alias("file_name"),
        (cells if max_sensors is None else F.slice(cells, 1, max_sensors)).alias("_cells")))


def _numbers(lines: DataFrame) -> DataFrame:
    """One row per cell of `_cells`."""
    return lines.select("folder", "file_name", F.posexplode("_cells").alias("_i", "_cell")).select(
        "folder", "file_name", (F.col("_i") + 1).cast("int").alias("sensor"),
        null_if_nan(F.col("_cell").try_cast("double")).alias("value"))


def signal_stats(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of `value` per key; partial sums are combined before the shuffle."""
    return signals.groupBy(*keys).agg(*[e.alias(n) for n, e in signal_statistics(F.col("value")).items()])


def sensor_run_features(
    signals: DataFrame, run_col: str = "run_id", file_col: str = "file_name",
    sensor_col: str = "sensor", max_sensors: int = MAX_SENSORS,
) -> DataFrame:
    """One row per run and file: time_index, timestamp, `s{i}_{statistic}` and RUL.

    time_index is the rank of the file name within its run and RUL the number of files that
    follow. Both come from positions over all files, so one long run is not sorted in one task.
    """
    per_sensor = {}
    for i in range(1, max_sensors + 1):
        per_sensor.update(signal_statistics(F.when(F.col(sensor_col) == i, F.col("value")), f"s{i}_"))
    files = signals.groupBy(run_col, file_col).agg(*[e.alias(n) for n, e in per_sensor.items()])
    placed = with_position(files, [run_col, file_col], unique=True)
    runs = placed.groupBy(run_col).agg(F.min(POSITION).alias("_first"), F.max(POSITION).alias("_last"))
    return placed.join(runs, run_col).select(
        run_col,
        (F.col(POSITION) - F.col("_first")).alias("time_index"),
        file_col,
        timestamp_from_name(F.col(file_col)).alias("timestamp"),
        *per_sensor,
        (F.col("_last") - F.col(POSITION)).alias("RUL"),
    )
