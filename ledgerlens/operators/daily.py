"""Aggregation to one row per business group and day, and the filling of missing days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.functions.coerce import ratio, safe_date, safe_numeric
from ledgerlens.schema import DATE, GROUP, SALES_COLUMNS, all_present, require_columns

# Measure columns of a day, set to zero on a day without sales.
BASE_METRICS = (
    "quantity_sum", "total_price_sum", "unit_price_mean", "discount_mean",
    "order_count", "customer_count", "avg_ticket",
)
FULL_METRICS = BASE_METRICS + ("quantity_mean", "quantity_std", "total_price_mean")


def add_avg_ticket(daily: DataFrame) -> DataFrame:
    """Money per distinct order; 0 where there is no order."""
    return daily.withColumn("avg_ticket", ratio(F.col("total_price_sum"), F.col("order_count"), 0.0))


def daily_metrics(
    df: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE,
    full: bool = False, formats: Sequence[str] = (),
) -> DataFrame:
    """One row per group and day; rows without a date or a group key are left out.

    The sums combine on the map side, so a group holding much of the table shrinks to its days
    before it is shuffled. `full` adds the mean and spread of the single sales.
    """
    require_columns(df, (set(SALES_COLUMNS) - {DATE}) | {date_col})
    group = list(group_cols)
    typed = df.select(
        *[F.col(c) for c in group],
        safe_date(df, date_col, formats).alias(date_col),
        *[safe_numeric(df, c).alias(c) for c in ("Quantity", "Unit_Price", "Discount", "Total_Price")],
        F.col("Order_ID").alias("_order"),
        F.col("Customer_ID").alias("_customer"),
    ).where(all_present([*group, date_col]))
    measures = [
        F.coalesce(F.sum("Quantity"), F.lit(0.0)).alias("quantity_sum"),
        F.coalesce(F.sum("Total_Price"), F.lit(0.0)).alias("total_price_sum"),
        F.avg("Unit_Price").alias("unit_price_mean"),
        F.avg("Discount").alias("discount_mean"),
        F.count_distinct("_order").alias("order_count"),
        F.count_distinct("_customer").alias("customer_count"),
    ]
    if full:
        measures += [
            F.avg("Quantity").alias("quantity_mean"),
            F.coalesce(F.stddev_samp("Quantity"), F.lit(0.0)).alias("quantity_std"),
            F.avg("Total_Price").alias("total_price_mean"),
        ]
    return add_avg_ticket(typed.groupBy(*group, date_col).agg(*measures))


def fill_missing_days(
    daily: DataFrame, group_cols: Sequence[str] = GROUP, date_col: str = DATE,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Every day between the first and last day of each group; measures of new days are zero.

    Each day is stretched up to the eve of the group's next one, so no calendar is joined. The
    window holds one row per day of a group, which the calendar bounds.

    The table may grow manyfold here, after the point where adaptive execution has merged small
    shuffle partitions by their size. The partitioning by group, which this and all later windows
    need anyway, is therefore asked for with its number of partitions.
    """
    group = list(group_cols)
    partitions = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    daily = daily.repartition(partitions, *group)
    if metrics is None:
        metrics = [m for m in FULL_METRICS if m in daily.columns]
    following = F.lead(date_col).over(Window.partitionBy(*group).orderBy(date_col))
    last = F.coalesce(F.date_sub(following, 1), F.col(date_col))
    stretched = daily.withColumn("_last", last).withColumn(
        "_day", F.explode(F.sequence(date_col, "_last", F.expr("interval 1 day"))))
    zero = {m: F.lit(0).cast(daily.schema[m].dataType) for m in metrics}
    observed = F.col("_day") == F.col(date_col)
    kept = [c for c in daily.columns if c not in (*group, date_col, *metrics)]
    return stretched.select(
        *group,
        F.col("_day").alias(date_col),
        *[F.when(observed, F.coalesce(F.col(m), zero[m])).otherwise(zero[m]).alias(m) for m in metrics],
        *[F.when(observed, F.col(c)).alias(c) for c in kept],
    )
