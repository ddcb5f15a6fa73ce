"""Quality rules over the sales table, and the fixes that go with them.

A report reads the table once: rows are first reduced to distinct rows with their number of
copies (which is the duplicate rule), and every other rule is a sum over those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.coerce import clip, round_half_even, safe_datetime, safe_numeric
from ledgerlens.operators.ordered import in_blocks, neighbour, own_rows, with_position
from ledgerlens.schema import DATE, GROUP, require_columns

DUPLICATES = "duplicates"
COPIES = "_copies"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    recommendation: str


# Rule titles, severities and advice shown in reports, in report order.
RULES = {
    "quantity_missing": Rule("Missing Quantity", "Medium",
                             "Impute missing Quantity with zero if business meaning is 'no units sold'."),
    "quantity_negative": Rule("Negative Quantity", "High",
                              "Replace negative Quantity with zero or review source transactions."),
    "discount_missing": Rule("Missing Discount", "Low", "Set missing Discount to zero."),
    "discount_negative": Rule("Negative Discount", "High", "Set negative Discount to zero."),
    "discount_above_one": Rule("Discount Above One", "High", "Clip Discount to valid range [0, 1]."),
    "customer_type_invalid": Rule("Invalid Customer Type", "Medium",
                                  "Review or standardize Customer_Type values to B2B/B2C."),
    "b2c_discount": Rule("B2C Discount Rule Violation", "High", "Set Discount to zero for B2C records."),
    "order_date_invalid": Rule("Invalid Order Date", "High",
                               "Parse Order_Date and review invalid date records."),
    "duplicates": Rule("Exact Duplicate Rows", "Medium", "Remove exact duplicate rows."),
    "total_price": Rule("Total Price Consistency", "High", "Recalculate Total_Price."),
}

# Accepted customer types.
CUSTOMER_TYPES = ("B2B", "B2C")


def price_check(df: DataFrame) -> dict[str, Column]:
    """Numeric copies of the price inputs, the price they imply, and its distance from the stated one."""
    unit, quantity = safe_numeric(df, "Unit_Price"), safe_numeric(df, "Quantity")
    discount = clip(F.coalesce(safe_numeric(df, "Discount"), F.lit(0.0)), 0, 1)
    stated = round_half_even(safe_numeric(df, "Total_Price"))
    expected = round_half_even(unit * quantity * (1 - discount))
    return {
        "Unit_Price_num": unit,
        "Quantity_num": quantity,
        "Discount_num": discount,
        "Total_Price_num": stated,
        "Expected_Total": expected,
        "Diff": round_half_even(F.abs(expected - stated)),
    }


_TYPED = {"_quantity": "Quantity", "_discount": "Discount"}


def _typed(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Read each cell once, ahead of the aggregation, for the rules that look at it."""
    used = {"_quantity": {"quantity_missing", "quantity_negative"}, "_date": {"order_date_invalid"},
            "_discount": {"discount_missing", "discount_negative", "discount_above_one", "b2c_discount"},
            "_diff": {"total_price"}}
    wanted = {name for name, by in used.items() if by & set(rules)}
    columns = {name: safe_numeric(df, source) for name, source in _TYPED.items() if name in wanted}
    if "_date" in wanted:
        columns["_date"] = safe_datetime(df, DATE)
    if "_diff" in wanted:
        columns["_diff"] = price_check(df)["Diff"]
    return df.withColumns(columns) if columns else df


def _violations(tolerance: float) -> dict[str, Column]:
    quantity, discount, customer = F.col("_quantity"), F.col("_discount"), F.col("Customer_Type")
    return {
        "quantity_missing": quantity.isNull(),
        "quantity_negative": quantity < 0,
        "discount_missing": discount.isNull(),
        "discount_negative": discount < 0,
        "discount_above_one": discount > 1,
        "customer_type_invalid": ~F.coalesce(customer.isin(*CUSTOMER_TYPES), F.lit(False)),
        "b2c_discount": (customer == "B2C") & (discount > 0),
        "order_date_invalid": F.col("_date").isNull(),
        "total_price": F.col("_diff") > tolerance,
    }


def count_issues(df: DataFrame, rules: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """One row, one column per rule with the number of rows that break it."""
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValueError(f"unknown rules: {unknown}")
    violations = _violations(tolerance)
    if DUPLICATES in rules:
        df = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))
        weight = F.col(COPIES)
    else:
        weight = F.lit(1).cast("bigint")
    counts = []
    for rule in rules:
        hits = weight - 1 if rule == DUPLICATES else F.when(violations[rule], weight)
        counts.append(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias(rule))
    return _typed(df, rules).agg(*counts)


def report_rows(counts: DataFrame, rules: dict[str, Rule], with_recommendation: bool = False) -> DataFrame:
    """Turn a one-row table of counts into one report row per rule."""
    entries = []
    for i, (key, rule) in enumerate(rules.items()):
        fields = [
            F.lit(i).alias("rule_no"),
            F.lit(rule.name).alias("rule_name"),
            F.when(F.col(key) > 0, "YES").otherwise("NO").alias("issue_found"),
            F.col(key).cast("bigint").alias("issue_count"),
            F.lit(rule.severity).alias("severity"),
        ]
        if with_recommendation:
            fields.append(F.lit(rule.recommendation).alias("recommendation"))
        entries.append(F.struct(*fields))
    return counts.select(F.inline(F.array(*entries)))


def rule_report(df: DataFrame, rule: str, tolerance: float = 0.1) -> DataFrame:
    """The report row of one rule, with its recommendation."""
    counts = count_issues(df, [rule], tolerance)
    return report_rows(counts, {rule: RULES[rule]}, with_recommendation=True).drop("rule_no")


def quality_report(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """All ten rules: one scan, one shuffle of distinct rows."""
    return report_rows(count_issues(df, list(RULES), tolerance), RULES).drop("rule_no")


def summary_text(counts: DataFrame, rules: dict[str, Rule], title: str, underline: int) -> DataFrame:
    """One row with the short text summary of a report."""
    rows = report_rows(counts, rules)
    high = F.when((F.col("issue_found") == "YES") & (F.col("severity") == "High"),
                  F.struct("rule_no", "rule_name"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("rules"),
        F.count(F.when(F.col("issue_found") == "YES", 1)).alias("with_issues"),
        F.sum("issue_count").alias("issues"),
        F.sort_array(F.collect_list(high)).alias("high"),  # at most one entry per rule
    )
    names = F.when(F.size("high") > 0, F.array_join(F.col("high.rule_name"), ", ")).otherwise(
        "No high-severity issues were detected")
    text = F.concat(
        F.lit(f"{title}\n{'-' * underline}\nRules evaluated: "), F.col("rules").cast("string"),
        F.lit("\nRules with issues found: "), F.col("with_issues").cast("string"),
        F.lit("\nTotal issue count: "), F.col("issues").cast("string"),
        F.lit("\nHigh-severity issues: "), names, F.lit("\n"),
    )
    return facts.select(text.alias("summary"))


def executive_summary(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return summary_text(count_issues(df, list(RULES), tolerance), RULES, "Data Quality Executive Summary", 30)


def price_inconsistencies(
    df: DataFrame, tolerance: float = 0.1, n: int = 20, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The `n` rows whose stated price is furthest from the implied one."""
    shown = ["Product", "Region", DATE]
    checked = df.withColumns(price_check(df)).where(F.col("Diff") > tolerance)
    ties = [c for c in [*shown, *tie_break] if c in checked.columns]
    return checked.orderBy(F.desc("Diff"), *ties).limit(n).select(
        *shown, "Unit_Price_num", "Quantity_num", "Discount_num", "Total_Price_num", "Expected_Total", "Diff")


def duplicate_rows_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))
    return copies.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def duplicate_keys_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first for each combination of `keys`."""
    require_columns(df, keys)
    return duplicate_rows_count(df.select(*keys)).withColumnRenamed("duplicate_rows", "duplicate_keys")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of nulls of each column."""
    require_columns(df, columns)
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])


# Fixes ---------------------------------------------------------------------------------------

def fix_quantity_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("Quantity", F.coalesce(safe_numeric(df, "Quantity"), F.lit(0.0)))


def _floor_at_zero(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, clip(safe_numeric(df, column), lower=0))


def fix_quantity_negative(df: DataFrame) -> DataFrame:
    return _floor_at_zero(df, "Quantity")


def fix_discount_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("Discount", F.coalesce(safe_numeric(df, "Discount"), F.lit(0.0)))


def fix_discount_negative(df: DataFrame) -> DataFrame:
    return _floor_at_zero(df, "Discount")


def fix_discount_range(df: DataFrame, lower: float = 0, upper: float = 1) -> DataFrame:
    return df.withColumn("Discount", clip(F.coalesce(safe_numeric(df, "Discount"), F.lit(0.0)), lower, upper))


def fix_b2c_discount(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "Discount",
        F.when(F.col("Customer_Type") == "B2C", 0.0).otherwise(F.coalesce(safe_numeric(df, "Discount"), F.lit(0.0))))


def fix_order_date(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(DATE, safe_datetime(df, DATE, formats))


def fix_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fix_total_price(df: DataFrame, digits: int = 2) -> DataFrame:
    """Recompute the price from cleaned inputs, which are stored too."""
    cleaned = df.withColumns({
        "Unit_Price": safe_numeric(df, "Unit_Price"),
        "Quantity": F.coalesce(safe_numeric(df, "Quantity"), F.lit(0.0)),
        "Discount": clip(F.coalesce(safe_numeric(df, "Discount"), F.lit(0.0)), 0, 1),
    })
    implied = F.col("Unit_Price") * F.col("Quantity") * (1 - F.col("Discount"))
    return cleaned.withColumn("Total_Price", round_half_even(implied, digits))


def fix_neighbor_mean(
    df: DataFrame,
    group_cols: Sequence[str] = GROUP,
    target_col: str = "Total_Price",
    tie_break: Sequence[str] = (),
    unique_order: bool = False,
) -> DataFrame:
    """Fill a missing value with the mean of the rows just before and after it in its group.

    Rows are ordered by date, then by `tie_break`. The value stays null when either neighbour is
    null or absent. The order is cut into equal blocks, so a group holding most of the table is
    spread like any other. `unique_order` promises that group, date and tie break name one row.
    """
    require_columns(df, [*group_cols, target_col, DATE])
    typed = df.withColumns({DATE: safe_datetime(df, DATE), target_col: safe_numeric(df, target_col)})
    placed = with_position(typed, [*group_cols, DATE, *tie_break], unique=unique_order)
    x = F.col(target_col)
    near = in_blocks(placed, before=1, after=1).withColumn(
        "_near", (neighbour(x, -1, group_cols) + neighbour(x, 1, group_cols)) / 2)
    return own_rows(near).withColumn(target_col, F.coalesce(x, F.col("_near"))).drop("_near")


def apply_all_fixes(df: DataFrame, recalc_total_price: bool = True, formats: Sequence[str] = ()) -> DataFrame:
    """Every value fix, then the removal of rows that are equal by then, then the price."""
    fixed = (
        df.transform(fix_quantity_missing)
        .transform(fix_quantity_negative)
        .transform(fix_discount_missing)
        .transform(fix_discount_negative)
        .transform(fix_discount_range)
        .transform(fix_b2c_discount)
        .transform(fix_order_date, formats)
        .transform(fix_duplicates)
    )
    return fixed.transform(fix_total_price) if recalc_total_price else fixed
