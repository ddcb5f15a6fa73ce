"""Series of a measure over time, and statistical bands that mark outliers in it."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.coerce import safe_numeric
from ledgerlens.operators.filters import select_measure
from ledgerlens.operators.ordered import BLOCK, OWN, POSITION, block_window, in_blocks, own_rows, with_position
from ledgerlens.operators.quantiles import column_quantiles, exact_quantiles
from ledgerlens.schema import DATE
from ledgerlens.session import materialise

# Tasks receive these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUARTILES = (0.25, 0.5, 0.75)
AGGREGATES = ("sum", "mean", "median", "count")
METHODS = ("iqr", "zscore")


def daily_series(
    df: DataFrame, value_col: str, agg: str = "sum", filters: Mapping[str, object] | None = None,
    start=None, end=None, date_col: str = DATE,
) -> DataFrame:
    """One row per distinct time stamp: sum, mean, median or count of the measure."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    rows = select_measure(df, value_col, filters, start, end, date_col)
    rows = rows.withColumn(value_col, safe_numeric(rows, value_col))
    if agg == "median":
        return exact_quantiles(rows, value_col, {value_col: 0.5}, [date_col])
    value = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg](value_col)
    return rows.groupBy(date_col).agg(value.alias(value_col))


def _marked(banded: DataFrame, value: Column) -> DataFrame:
    outside = (value < F.col("lower_limit")) | (value > F.col("upper_limit"))
    return banded.withColumn("is_outlier", F.coalesce(outside, F.lit(False)))


def iqr_limits(q1, q3, multiplier: float):
    spread = q3 - q1
    return q1 - multiplier * spread, q3 + multiplier * spread


def global_band(
    series: DataFrame, value_col: str, method: str = "iqr",
    iqr_multiplier: float = 1.5, z_threshold: float = 3.0,
) -> DataFrame:
    """One band for the whole series, learnt first and then applied as constants."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "iqr":
        q1, reference, q3 = column_quantiles(series, [value_col], [0.25, 0.5, 0.75])[value_col]
        lower, upper = (None, None) if q1 is None else iqr_limits(q1, q3, iqr_multiplier)
    else:
        reference, spread = series.agg(F.avg(value_col), F.coalesce(F.stddev_samp(value_col), F.lit(0.0))).first()
        lower, upper = (None, None) if reference is None else (
            reference - z_threshold * spread, reference + z_threshold * spread)
    banded = series.withColumns({
        name: F.lit(x).cast("double") for name, x in
        (("lower_limit", lower), ("upper_limit", upper), ("reference", reference))})
    return _marked(banded, F.col(value_col))


def _moving_quartiles(values: np.ndarray, window: int) -> np.ndarray:
    """Interpolated quartiles of the last `window` values at each place; NaN is a missing value.

    The window is kept in order: a step inserts one value and removes one.
    """
    out = np.full((len(values), len(QUARTILES)), np.nan)
    held: list[float] = []
    for i, x in enumerate(values.tolist()):
        if i >= window and values[i - window] == values[i - window]:
            del held[bisect_left(held, values[i - window])]
        if x == x:
            insort(held, x)
        for j, p in enumerate(QUARTILES if held else ()):
            at = (len(held) - 1) * p
            low = int(at)
            out[i, j] = held[low] if at == low else held[low] * (low + 1 - at) + held[low + 1] * (at - low)
    return out


def _with_moving_quartiles(blocked: DataFrame, value: Column, window: int) -> DataFrame:
    """The own rows of each block with `_q0`, `_q1`, `_q2`, null where the window holds no value."""
    kept = [c for c in blocked.columns if c not in (BLOCK, OWN)]

    def rolled(block: pa.Table) -> pa.Table:
        block = block.sort_by(POSITION)
        found = _moving_quartiles(block["_x"].to_numpy(zero_copy_only=False).astype(float), window)
        own = block[OWN]
        block = block.select(kept)
        for j in range(len(QUARTILES)):
            block = block.append_column(f"_q{j}", pa.array(found[:, j], pa.float64(), from_pandas=True))
        return block.filter(own)

    schema = blocked.select(*kept, *[F.lit(None).cast("double").alias(f"_q{j}") for j in range(len(QUARTILES))]).schema
    return blocked.withColumn("_x", value).groupBy(BLOCK).applyInArrow(rolled, schema)


def rolling_band(
    series: DataFrame, value_col: str, window: int, method: str = "iqr",
    iqr_multiplier: float = 1.5, z_threshold: float = 3.0, date_col: str = DATE,
) -> DataFrame:
    """A band from the last `window` points, today included.

    The series has no grouping key, so its order is cut into blocks that borrow the `window` − 1
    points before them. Quartiles move along a block in order, so a point costs little more in a long
    window than in a short one.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    placed = with_position(series, [date_col], unique=True)
    blocked = in_blocks(placed, before=window - 1, after=0)
    x = F.col(value_col).cast("double")
    if method == "iqr":
        rolled = _with_moving_quartiles(blocked, x, window)
        lower, upper = iqr_limits(F.col("_q0"), F.col("_q2"), iqr_multiplier)
        banded = rolled.withColumns({"lower_limit": lower, "upper_limit": upper, "reference": F.col("_q1")}).drop(
            POSITION, "_q0", "_q1", "_q2")
    else:
        frame = block_window().rowsBetween(-(window - 1), 0)
        rolled = blocked.withColumns({
            "reference": F.avg(x).over(frame), "_spread": F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0))})
        half = z_threshold * F.col("_spread")
        banded = own_rows(rolled).withColumns({
            "lower_limit": F.col("reference") - half, "upper_limit": F.col("reference") + half}).drop("_spread")
    return _marked(banded, F.col(value_col))


def outliers_by_period(
    df: DataFrame, value_col: str, filters: Mapping[str, object] | None = None, start=None, end=None,
    agg: str = "sum", method: str = "iqr", iqr_multiplier: float = 1.5, z_threshold: float = 3.0,
    moving_window: int | None = None, date_col: str = DATE,
) -> DataFrame:
    """date, value, lower_limit, upper_limit, reference, is_outlier.

    A moving window below 2 means one band for the whole period.
    """
    series = daily_series(df, value_col, agg, filters, start, end, date_col)
    if moving_window is not None and moving_window >= 2:
        banded = rolling_band(series, value_col, moving_window, method, iqr_multiplier, z_threshold, date_col)
    else:
        # The band and its use both read the series; the sales behind it are read once.
        banded = global_band(materialise(series), value_col, method, iqr_multiplier, z_threshold)
    return banded.select(date_col, value_col, "lower_limit", "upper_limit", "reference", "is_outlier")
