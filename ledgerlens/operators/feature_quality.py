"""Quality rules over the feature table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.features import DERIVED_COLUMNS
from ledgerlens.operators.quality import Rule, report_rows, summary_text

# Rule titles, severities and advice shown in reports, in report order.
FEATURE_RULES = {
    "missing": Rule("Missing Derived Feature Values", "High", "Apply fix_missing_feature_values()."),
    "negative": Rule("Negative Aggregated Metrics", "Medium",
                     "Review raw transactional data before feature generation."),
    "calendar": Rule("Invalid Calendar Features", "Low",
                     "Rebuild calendar features from parsed Order_Date."),
}

# Measures that must not be negative, and the accepted range of calendar columns.
NON_NEGATIVE = ("quantity_sum", "total_price_sum", "order_count", "customer_count", "avg_ticket")
CALENDAR_RANGES = {"day_of_week": (0, 6), "month": (1, 12), "is_weekend": (0, 1)}


def _hits(df: DataFrame, rule: str) -> list[Column]:
    """One condition per checked cell; a row may break a rule in several columns."""
    if rule == "missing":
        return [F.col(c).isNull() for c in DERIVED_COLUMNS if c in df.columns]
    if rule == "negative":
        return [F.col(c) < 0 for c in NON_NEGATIVE if c in df.columns]
    return [~F.coalesce(F.col(c).between(low, high) & (F.col(c) == F.floor(c)), F.lit(False))
            if c == "is_weekend" else ~F.coalesce(F.col(c).between(low, high), F.lit(False))
            for c, (low, high) in CALENDAR_RANGES.items() if c in df.columns]


def count_feature_issues(features: DataFrame) -> DataFrame:
    """One row with the three counts, from one pass."""
    counts = []
    for rule in FEATURE_RULES:
        cells = [F.coalesce(h, F.lit(False)).cast("bigint") for h in _hits(features, rule)]
        total = reduce(add, cells, F.lit(0).cast("bigint"))
        counts.append(F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias(rule))
    return features.agg(*counts)


def feature_rule_report(features: DataFrame, rule: str) -> DataFrame:
    counts = count_feature_issues(features).select(rule)
    return report_rows(counts, {rule: FEATURE_RULES[rule]}, with_recommendation=True).drop("rule_no")


def feature_quality_report(features: DataFrame) -> DataFrame:
    return report_rows(count_feature_issues(features), FEATURE_RULES).drop("rule_no")


def feature_executive_summary(features: DataFrame) -> DataFrame:
    return summary_text(count_feature_issues(features), FEATURE_RULES, "Feature Quality Executive Summary", 32)
