"""CSV and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.functions.coerce import nan_to_null
from ledgerlens.operators.anomalies import top_anomalies

CODEC = "snappy"
EXPORT_CODEC = "zstd"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Headered CSV. With a schema, one pass and null for a bad cell; without, types are inferred."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    return nan_to_null(reader.schema(schema).csv(path))


def scan_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, nan_as_null: bool = False,
) -> DataFrame:
    """Parquet, optionally some columns; a missing path is an error.

    Tables this package wrote hold no NaN, so that predicates on measures reach the files. For others
    `nan_as_null` replaces NaN on reading, which keeps such predicates from being pushed down.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns is not None else df
    return nan_to_null(df) if nan_as_null else df


def sink_parquet(
    df: DataFrame, path: str, compression: str = CODEC, overwrite: bool = True, partition_by: Sequence[str] = (),
) -> None:
    """Write Parquet, NaN as null; without `overwrite` an existing path is an error."""
    writer = nan_to_null(df).write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_scored(scored: DataFrame, path: str) -> None:
    """Scored table for downstream readers."""
    sink_parquet(scored, path, compression=EXPORT_CODEC)


def export_top_anomalies(scored: DataFrame, path: str, n: int = 20, product=None, region=None) -> None:
    """The worst `n` anomalies as headered CSV; the list is short, so it is one file."""
    top_anomalies(scored, n, product, region).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def schema_profile(df: DataFrame) -> DataFrame:
    """Column name, type, rows and non-null rows, from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.lit(dtype).alias("column_type"),
                 F.col("rows"), F.col(f"n{i}").alias("non_null_rows"))
        for i, (name, dtype) in enumerate(df.dtypes)]
    return counted.select(F.inline(F.array(*entries)))


def roundtrip_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in `a`, rows only in `b`, and whether the schemas agree.

    Rows are counted per distinct row on both sides in one shuffle; copies count.
    """
    same_schema = [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
    if set(a.columns) != set(b.columns):
        raise ValueError("tables have different columns")
    sided = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    excess = sided.groupBy(*a.columns).agg(F.sum("_side").alias("_excess"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return excess.agg(
        total(F.when(F.col("_excess") > 0, F.col("_excess"))).alias("only_in_first"),
        total(F.when(F.col("_excess") < 0, -F.col("_excess"))).alias("only_in_second"),
    ).withColumn("same_schema", F.lit(same_schema))
