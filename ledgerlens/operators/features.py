"""Window features over the daily table.

All frames of one group share a partitioning and an order, so Spark evaluates them in one sort
and one window step. A window holds the days of one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.calendar import add_calendar
from ledgerlens.functions.coerce import ratio
from ledgerlens.operators.daily import daily_metrics, fill_missing_days
from ledgerlens.schema import DATE, GROUP

# Fixed values: (measure, statistic, rows) of the compact feature set, and its derived columns.
ROLLING = (
    ("quantity_sum", "mean", 7), ("quantity_sum", "std", 7), ("quantity_sum", "sum", 7),
    ("total_price_sum", "mean", 7), ("total_price_sum", "std", 7), ("total_price_sum", "mean", 30),
    ("unit_price_mean", "mean", 7), ("discount_mean", "mean", 14),
)
DEVIATIONS = ("quantity_vs_mean_7d", "total_price_vs_mean_30d", "quantity_pct_vs_mean_7d")
ROLLING_COLUMNS = tuple(f"{m}_{s}_{w}d" for m, s, w in ROLLING)
DERIVED_COLUMNS = ROLLING_COLUMNS + DEVIATIONS
TARGET_ROWS = (7, 14, 30)
HISTORY_ROWS = (7, 30)

# Measures, statistics and windows of the wide feature set.
WIDE_METRICS = ("quantity_sum", "total_price_sum", "unit_price_mean", "discount_mean", "order_count", "avg_ticket")
WIDE_STATISTICS = ("mean", "std", "sum")
WIDE_WINDOWS = (7, 14, 30)
WIDE_DEVIATIONS = (
    ("quantity", "quantity_sum"), ("total_price", "total_price_sum"),
    ("unit_price", "unit_price_mean"), ("discount", "discount_mean"),
)

_STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def _days(group_cols: Sequence[str], date_col: str):
    return Window.partitionBy(*group_cols).orderBy(date_col)


def past_statistic(
    metric: str, statistic: str, rows: int, group_cols: Sequence[str] = GROUP,
    date_col: str = DATE, min_periods: int = 1,
) -> Column:
    """Statistic of the previous `rows` rows, today excluded, null with fewer than `min_periods`."""
    frame = _days(group_cols, date_col).rowsBetween(-rows, -1)
    value = _STATISTICS[statistic](F.col(metric).cast("double")).over(frame)
    if min_periods == 0 and statistic == "sum":
        return F.coalesce(value, F.lit(0.0))
    if min_periods > 1:
        return F.when(F.count(metric).over(frame) >= min_periods, value)
    return value


def add_rolling(daily: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE) -> DataFrame:
    """The compact set: eight rolling columns and three deviations from them."""
    rolled = daily.withColumns({
        f"{m}_{s}_{w}d": past_statistic(m, s, w, group_cols, date_col) for m, s, w in ROLLING})
    return add_deviations(rolled)


def add_deviations(rolled: DataFrame) -> DataFrame:
    quantity, usual = F.col("quantity_sum"), F.col("quantity_sum_mean_7d")
    return rolled.withColumns({
        "quantity_vs_mean_7d": quantity - usual,
        "total_price_vs_mean_30d": F.col("total_price_sum") - F.col("total_price_sum_mean_30d"),
        "quantity_pct_vs_mean_7d": ratio(quantity - usual, usual),
    })


def add_history_flags(daily: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE) -> DataFrame:
    """1 on rows with fewer than 7 (30) earlier rows in their group."""
    number = F.row_number().over(_days(group_cols, date_col))
    return daily.withColumns({
        f"history_less_than_{n}d": (number <= n).cast("int") for n in HISTORY_ROWS})


def add_future_targets(daily: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE) -> DataFrame:
    """Quantity over the next 7, 14 and 30 rows; null on the last row of a group."""
    days = _days(group_cols, date_col)
    return daily.withColumns({
        f"quantity_sum_next_{n}d": F.sum("quantity_sum").over(days.rowsBetween(1, n)) for n in TARGET_ROWS})


def fill_initial_nulls(features: DataFrame) -> DataFrame:
    """Zero for derived columns that lack history; future targets stay null."""
    return features.fillna(0.0, subset=[c for c in DERIVED_COLUMNS if c in features.columns])


def build_features(
    df: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE, fill_days: bool = True,
) -> DataFrame:
    """Sales rows to the complete compact feature table."""
    daily = daily_metrics(df, group_cols, date_col)
    if fill_days:
        daily = fill_missing_days(daily, group_cols, date_col)
    days = _days(group_cols, date_col)
    number = F.row_number().over(days)
    # One projection, so that past frames, future frames and the row number share one window step.
    framed = add_calendar(daily, date_col).withColumns({
        **{f"{m}_{s}_{w}d": past_statistic(m, s, w, group_cols, date_col) for m, s, w in ROLLING},
        **{f"history_less_than_{n}d": (number <= n).cast("int") for n in HISTORY_ROWS},
        **{f"quantity_sum_next_{n}d": F.sum("quantity_sum").over(days.rowsBetween(1, n)) for n in TARGET_ROWS},
    })
    return fill_initial_nulls(add_deviations(framed))


def rebuild_calendar(features: DataFrame, date_col: str = DATE) -> DataFrame:
    return add_calendar(features, date_col)


def rebuild_rolling(features: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE) -> DataFrame:
    return fill_initial_nulls(add_rolling(features, group_cols, date_col))


def rebuild_flags(features: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE) -> DataFrame:
    return add_history_flags(features, group_cols, date_col)


# The wide set --------------------------------------------------------------------------------

def add_wide_rolling(
    daily: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE,
    windows: Sequence[int] = WIDE_WINDOWS, min_periods: int = 1,
) -> DataFrame:
    """Mean, spread and sum of six measures over each window; a missing spread is zero."""
    columns = {}
    for w in windows:
        for m in WIDE_METRICS:
            for s in WIDE_STATISTICS:
                value = past_statistic(m, s, w, group_cols, date_col, min_periods)
                columns[f"{m}_{s}_{w}d"] = F.coalesce(value, F.lit(0.0)) if s == "std" else value
    return daily.withColumns(columns)


def add_wide_deviations(rolled: DataFrame, windows: Sequence[int] = WIDE_WINDOWS) -> DataFrame:
    return rolled.withColumns({
        f"{short}_vs_mean_{w}d": F.col(m) - F.col(f"{m}_mean_{w}d") for w in windows for short, m in WIDE_DEVIATIONS})


def add_wide_percentages(rolled: DataFrame, windows: Sequence[int] = WIDE_WINDOWS) -> DataFrame:
    """Relative distance of quantity from its rolling mean; null where that mean is zero."""
    q = F.col("quantity_sum")
    means = {w: F.col(f"quantity_sum_mean_{w}d") for w in windows}
    return rolled.withColumns({f"quantity_pct_vs_mean_{w}d": ratio(q - m, m) for w, m in means.items()})


def build_wide_features(
    df: DataFrame, date_col: str = DATE, group_cols: Sequence[str] = GROUP,
    windows: Sequence[int] = WIDE_WINDOWS, min_periods: int = 1, fill_days: bool = True,
) -> DataFrame:
    """Sales rows to the wide feature table; only the spreads are filled."""
    daily = daily_metrics(df, group_cols, date_col, full=True)
    if fill_days:
        daily = fill_missing_days(daily, group_cols, date_col)
    rolled = add_wide_rolling(add_calendar(daily, date_col, with_day=True), group_cols, date_col, windows, min_periods)
    return add_wide_percentages(add_wide_deviations(rolled, windows), windows)
