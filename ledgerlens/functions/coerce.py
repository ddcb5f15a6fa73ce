"""Coercion and arithmetic whose null and rounding rules follow the pandas conventions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def null_if_nan(c: Column) -> Column:
    return F.nullif(c, F.lit(math.nan))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, once, where data enters."""
    floating = (T.DoubleType, T.FloatType)
    return df.select([
        null_if_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def safe_numeric(df: DataFrame, name: str) -> Column:
    """Number held by column `name`, null where it is not a number."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        # The JVM parser also takes Java literals such as '1d' or '0x1p3'; those are not numbers here.
        c = F.when(~c.rlike(r"(?i)(?<!in)[df]\s*$|x"), c)
        return null_if_nan(c.try_cast("double"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return null_if_nan(c.cast("double"))
    return c.cast("double")


def safe_datetime(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp held by column `name`, null where it cannot be read.

    ISO text is always accepted; `formats` adds further patterns, tried first.
    """
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        tried = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
        return F.coalesce(*tried, c.try_cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def safe_date(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """`safe_datetime` brought to midnight, as a DATE."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    return safe_datetime(df, name, formats).cast("date")


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound `c`; a null stays null although greatest and least would skip it."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def finite(c: Column) -> Column:
    """`c` with NaN and both infinities replaced by null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    scale = F.lit(float(10 ** digits))
    return F.rint(c * scale) / scale


def ratio(numerator: Column, denominator: Column, otherwise=None) -> Column:
    """Quotient, or `otherwise` where the denominator is zero or null."""
    return F.when(F.coalesce(denominator, F.lit(0)) != 0, numerator / denominator).otherwise(
        F.lit(otherwise).cast("double"))
