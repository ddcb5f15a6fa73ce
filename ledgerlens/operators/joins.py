"""Equi-joins of sales, features, scores and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.ordered import POSITION, with_position
from ledgerlens.schema import DATE, require_columns

SCORE_COLUMNS = (
    "anomaly_flag", "anomaly_label", "anomaly_score",
    "if_qty_signal", "if_sales_signal", "if_discount_signal", "if_ticket_signal",
)


def join_feature_keys(sales: DataFrame, features: DataFrame) -> DataFrame:
    """Left join on product, region and day; the two Category columns become _x and _y."""
    keys = ["Product", "Region", DATE]
    right = features.select(*keys, F.col("Category").alias("Category_y"))
    return sales.withColumnRenamed("Category", "Category_x").join(right, keys, "left")


def join_features(
    sales: DataFrame, features: DataFrame, keys: Sequence[str] = ("Category", "Product", "Region", DATE),
) -> DataFrame:
    """Give every sale the features of its group and day.

    A hot group makes the sales side skewed; adaptive execution splits such partitions, or
    broadcasts the features when their size allows it.
    """
    return sales.join(features, list(keys), "left")


def join_scores(
    features: DataFrame, scored: DataFrame, keys: Sequence[str] = (DATE, "Product", "Region"),
) -> DataFrame:
    """Add only the anomaly columns of the scored table."""
    added = [c for c in SCORE_COLUMNS if c in scored.columns and c not in features.columns]
    return features.join(scored.select(*keys, *added), list(keys), "left")


def _once(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """`df` with an error for a repeated key; the join needs the same shuffle anyway."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.any_value(c).alias(c) for c in others])
    repeated = F.raise_error(F.concat(F.lit(f"repeated key in {side}: "), F.to_json(F.struct(*keys))))
    # Every kept column passes through the check, so pruning cannot drop it.
    checked = [F.when(F.col("_rows") == 1, F.col(c)).otherwise(repeated.cast(df.schema[c].dataType)).alias(c)
               for c in others]
    return grouped.select(*keys, *checked)


def align_models(
    baseline: DataFrame, anomaly: DataFrame, id_columns: Sequence[str],
    target_col: str = "quantity_sum", flag_col: str = "anomaly_flag",
    baseline_pred: str = "baseline_pred", anomaly_pred: str = "anomaly_pred",
) -> DataFrame:
    """Inner join of two prediction tables on their id columns, each id at most once per side."""
    ids = list(id_columns)
    require_columns(baseline, [*ids, target_col, baseline_pred])
    require_columns(anomaly, [*ids, target_col, flag_col, anomaly_pred])
    left = _once(anomaly.select(*ids, target_col, flag_col, anomaly_pred), ids, "the anomaly table")
    right = _once(baseline.select(*ids, baseline_pred), ids, "the baseline table")
    return left.join(right, ids).select(*ids, target_col, flag_col, baseline_pred, anomaly_pred)


def align_by_order(
    baseline: DataFrame, anomaly: DataFrame, baseline_order: Sequence[str], anomaly_order: Sequence[str],
    target_col: str = "quantity_sum", flag_col: str = "anomaly_flag",
    baseline_pred: str = "baseline_pred", anomaly_pred: str = "anomaly_pred",
    unique_order: bool = False,
) -> DataFrame:
    """Align two tables without ids: row i of one order with row i of the other.

    Tables of different length are an error.
    """
    left = with_position(anomaly.select(*{*anomaly_order, target_col, flag_col, anomaly_pred}),
                         anomaly_order, unique_order)
    right = with_position(baseline.select(*{*baseline_order, baseline_pred}), baseline_order, unique_order)
    if left.count() != right.count():
        raise ValueError("tables differ in length; give id columns to align them")
    return left.select(POSITION, target_col, flag_col, anomaly_pred).join(
        right.select(POSITION, baseline_pred), POSITION
    ).select(F.col(POSITION).alias("row"), target_col, flag_col, baseline_pred, anomaly_pred)


def union_groups(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
