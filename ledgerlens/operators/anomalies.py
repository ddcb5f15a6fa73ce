"""Reports over a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.coerce import ratio
from ledgerlens.operators.filters import by_product_region
from ledgerlens.schema import DATE, require_columns

# Columns shown by default in a list of anomalies.
TOP_COLUMNS = (
    "Order_Date", "Product", "Region", "total_price_sum", "quantity_sum", "avg_ticket",
    "if_qty_signal", "if_sales_signal", "if_discount_signal", "if_ticket_signal", "anomaly_score",
)
KEY = ("Product", "Region", DATE)


def anomaly_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("anomaly_flag") == 1)


def anomaly_summary(scored: DataFrame, product=None, region=None) -> DataFrame:
    """Rows, anomalies and their rate per product and region; null keys are groups of their own."""
    require_columns(scored, ["Product", "Region", "anomaly_flag"])
    return (
        by_product_region(scored, product, region).groupBy("Product", "Region")
        .agg(F.count("anomaly_flag").alias("total_rows"),
             F.coalesce(F.sum("anomaly_flag"), F.lit(0)).cast("bigint").alias("anomaly_count"))
        .withColumn("anomaly_rate", ratio(F.col("anomaly_count"), F.col("total_rows")))
        .orderBy(F.desc("anomaly_count"), F.desc("anomaly_rate"), "Product", "Region")
    )


def top_anomalies(
    scored: DataFrame, n: int = 10, product=None, region=None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """The `n` flagged rows with the lowest score; equal scores are ordered by key."""
    require_columns(scored, ["anomaly_flag", "anomaly_score"])
    shown = list(columns) if columns is not None else [c for c in TOP_COLUMNS if c in scored.columns]
    flagged = anomaly_rows(by_product_region(scored, product, region))
    ties = [c for c in KEY if c in flagged.columns]
    return flagged.orderBy(F.asc("anomaly_score"), *ties).limit(n).select(*shown)


def anomaly_timeseries(
    scored: DataFrame, value_col: str = "total_price_sum", product=None, region=None, date_col: str = DATE,
) -> DataFrame:
    """date, value and the series (Normal or Anomaly) each point is drawn in."""
    require_columns(scored, [date_col, value_col, "anomaly_flag"])
    series = F.when(F.col("anomaly_flag") == 1, "Anomaly").when(F.col("anomaly_flag") == 0, "Normal")
    kept = by_product_region(scored, product, region)
    ties = [c for c in ("Product", "Region") if c in scored.columns]
    return kept.select(date_col, *ties, value_col, series.alias("series")).orderBy(date_col, *ties)


def top_groups(df: DataFrame, column: str, n: int = 6) -> DataFrame:
    """The `n` most frequent values; equal counts are ordered by value."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), column).limit(n)
    )


def anomaly_timeseries_by_group(
    scored: DataFrame, group_by: str = "Product", value_col: str = "total_price_sum",
    product=None, region=None, max_groups: int = 6, date_col: str = DATE,
) -> DataFrame:
    """`anomaly_timeseries` for the most frequent products or regions."""
    if group_by not in ("Product", "Region"):
        raise ValueError("group_by must be 'Product' or 'Region'")
    kept = by_product_region(scored, product, region)
    # At most `max_groups` rows.
    chosen = F.broadcast(top_groups(kept, group_by, max_groups).select(group_by))
    return anomaly_timeseries(kept.join(chosen, group_by, "left_semi"), value_col, date_col=date_col)
