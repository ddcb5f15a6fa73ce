"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_remainder(c: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`; 0 for a null id."""
    return F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % divisor, F.lit(0))


def as_row(df: DataFrame, name: str = "row") -> Column:
    """The whole row as one struct, so that helper columns beside it can never clash with its columns."""
    return F.struct(*[field(c) for c in df.columns]).alias(name)


def unpack(df: DataFrame, columns: Sequence[str], added: dict[str, Column], row: str = "row") -> DataFrame:
    """The columns of the struct `row`, with `added` beside them; an added name replaces an old one."""
    taken = {c.lower() for c in added}
    kept = [F.col(row).getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def unit_hash(*parts: Column, bits: int = 30) -> Column:
    """Evenly spread value in [0, 1) that depends on the arguments alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << bits)) / float(1 << bits)
