"""Queries over the quality rules, the fixes and the feature pipeline."""

from __future__ import annotations

from ledgerlens.functions.calendar import add_calendar
from ledgerlens.operators import feature_quality, features, quality
from ledgerlens.operators.daily import fill_missing_days
from ledgerlens.schema import DATE
from workload import sql, views
from workload.registry import query, tidy
from workload.sql import r6, using

KEYS = ["Product", "Region", "Order_Date"]
SALE = ["Order_ID", "Customer_ID", "Customer_Type", "Product", "Category", "Region"]

# Issue counts -------------------------------------------------------------------------------

Q, D = "try_cast(Quantity as double)", "try_cast(Discount as double)"
PRICE = f"""abs(round_even(Unit_Price * {Q} * (1 - least(greatest(coalesce(Discount, 0), 0), 1)) * 100, 0) / 100
 - round_even(Total_Price * 100, 0) / 100)"""


def _violation(tolerance):
    return {
        "quantity_missing": f"{Q} is null", "quantity_negative": f"{Q} < 0",
        "discount_missing": f"{D} is null", "discount_negative": f"{D} < 0", "discount_above_one": f"{D} > 1",
        "customer_type_invalid": "coalesce(Customer_Type not in ('B2B', 'B2C'), true)",
        "b2c_discount": f"Customer_Type = 'B2C' and coalesce({D}, 0) > 0",
        "order_date_invalid": "try_cast(Order_Date as timestamp) is null",
        "duplicates": None,
        "total_price": f"round_even({PRICE} * 100, 0) / 100 > {tolerance}",
    }


# Name, severity and advice of each rule, written out so that the SQL does not take
# them from the code it checks.
RULE_TEXTS = {
    "quantity_missing": ("Missing Quantity", "Medium", "Impute missing Quantity with zero if business meaning is 'no units sold'."),
    "quantity_negative": ("Negative Quantity", "High", "Replace negative Quantity with zero or review source transactions."),
    "discount_missing": ("Missing Discount", "Low", "Set missing Discount to zero."),
    "discount_negative": ("Negative Discount", "High", "Set negative Discount to zero."),
    "discount_above_one": ("Discount Above One", "High", "Clip Discount to valid range [0, 1]."),
    "customer_type_invalid": ("Invalid Customer Type", "Medium", "Review or standardize Customer_Type values to B2B/B2C."),
    "b2c_discount": ("B2C Discount Rule Violation", "High", "Set Discount to zero for B2C records."),
    "order_date_invalid": ("Invalid Order Date", "High", "Parse Order_Date and review invalid date records."),
    "duplicates": ("Exact Duplicate Rows", "Medium", "Remove exact duplicate rows."),
    "total_price": ("Total Price Consistency", "High", "Recalculate Total_Price."),
}
# Measures of the wide set and those that may not be negative.
WIDE_METRICS = ("quantity_sum", "total_price_sum", "unit_price_mean", "discount_mean", "order_count", "avg_ticket")
WIDE_DEVIATIONS = (("quantity", "quantity_sum"), ("total_price", "total_price_sum"),
                   ("unit_price", "unit_price_mean"), ("discount", "discount_mean"))
NON_NEGATIVE = ("quantity_sum", "total_price_sum", "order_count", "customer_count", "avg_ticket")


def _counts(tolerance):
    rows = []
    for i, (key, (name, severity, advice)) in enumerate(RULE_TEXTS.items()):
        cond = _violation(tolerance)[key]
        count = (f"(select count(*) from dirty where {cond})" if cond
                 else "(select count(*) from dirty) - (select count(*) from (select distinct * from dirty) u)")
        rows.append(f"select {i} as no, '{name}' as rule_name, cast({count} as bigint) as issue_count, "
                    f"'{severity}' as severity, '{advice.replace(chr(39), chr(39) * 2)}' as recommendation")
    return " union all ".join(rows)


def _report(body):
    return f"select rule_name, case when issue_count > 0 then 'YES' else 'NO' end as issue_found, issue_count, severity{body}"


def _summary(title, underline, source):
    return f"""select '{title}' || chr(10) || '{'-' * underline}' || chr(10) || 'Rules evaluated: ' || count(*) || chr(10)
 || 'Rules with issues found: ' || count(case when issue_count > 0 then 1 end) || chr(10)
 || 'Total issue count: ' || cast(sum(issue_count) as bigint) || chr(10) || 'High-severity issues: '
 || coalesce(string_agg(case when issue_count > 0 and severity = 'High' then rule_name end, ', ' order by no),
  'No high-severity issues were detected') || chr(10) as summary from {source}"""


def _rule_query(key, tolerance=0.1):
    name = RULE_TEXTS[key][0]

    @query(f"dq_{key}", using("dirty", _report(", recommendation") + f" from c where rule_name = '{name}'", c=_counts(tolerance)))
    def run(spark, sf):
        return quality.rule_report(views.sales_dirty(spark, sf), key, tolerance)


for _key in quality.RULES:
    _rule_query(_key)


@query("dq_report", using("dirty", _report(" from c"), c=_counts(0.1)))
def dq_report(spark, sf):
    return quality.quality_report(views.sales_dirty(spark, sf), 0.1)


@query("dq_executive_summary", using("dirty", _summary("Data Quality Executive Summary", 30, "c"), c=_counts(0.01)))
def dq_executive_summary(spark, sf):
    return quality.executive_summary(views.sales_dirty(spark, sf))


@query("duplicate_rows_count", using("dirty", """select (select count(*) from dirty)
 - (select count(*) from (select distinct * from dirty) u) as duplicate_rows"""))
def duplicate_rows_count(spark, sf):
    return quality.duplicate_rows_count(views.sales_dirty(spark, sf))


# Fixes --------------------------------------------------------------------------------------

def _fix_query(name, fix, column, expr):
    @query(name, using("dirty", f"select {', '.join(SALE)}, Unit_Price, {r6(expr, column)} from dirty"))
    def run(spark, sf):
        return tidy(fix(views.sales_dirty(spark, sf)).select(*SALE, "Unit_Price", column))


_fix_query("fix_quantity_missing", quality.fix_quantity_missing, "Quantity", f"coalesce({Q}, 0)")
_fix_query("fix_quantity_negative", quality.fix_quantity_negative, "Quantity", f"case when {Q} < 0 then 0 else {Q} end")
_fix_query("fix_discount_missing", quality.fix_discount_missing, "Discount", f"coalesce({D}, 0)")
_fix_query("fix_discount_negative", quality.fix_discount_negative, "Discount", f"case when {D} < 0 then 0 else {D} end")
_fix_query("fix_discount_clip", quality.fix_discount_range, "Discount", f"least(greatest(coalesce({D}, 0), 0), 1)")
_fix_query("fix_b2c_discount", quality.fix_b2c_discount, "Discount",
           f"case when Customer_Type = 'B2C' then 0 else coalesce({D}, 0) end")
_fix_query("fix_total_price", quality.fix_total_price, "Total_Price",
           f"round_even(Unit_Price * coalesce({Q}, 0) * (1 - least(greatest(coalesce({D}, 0), 0), 1)) * 100, 0) / 100")


@query("fix_order_date", using("dirty", f"select {', '.join(SALE)}, try_cast(Order_Date as timestamp) as Order_Date from dirty"))
def fix_order_date(spark, sf):
    return quality.fix_order_date(views.sales_dirty(spark, sf)).select(*SALE, DATE)


DISTINCT_SQL = f"select distinct {', '.join(SALE)}, Unit_Price, Quantity, Discount, Total_Price, Order_Date from dirty"


@query("fix_duplicates", using("dirty", DISTINCT_SQL))
def fix_duplicates(spark, sf):
    return quality.fix_duplicates(views.sales_dirty(spark, sf))


@query("distinct_rows", using("dirty", f"select distinct {', '.join(SALE)} from dirty"))
def distinct_rows(spark, sf):
    return quality.fix_duplicates(views.sales_dirty(spark, sf).select(*SALE))


@query("apply_all_fixes", using("dirty", f"""select {', '.join(SALE)}, Unit_Price, Quantity, Discount, Order_Date,
 round_even(Unit_Price * Quantity * (1 - Discount) * 100, 0) / 100 as Total_Price from (
 select distinct {', '.join(SALE)}, Unit_Price, greatest(coalesce({Q}, 0), 0) as Quantity,
  case when Customer_Type = 'B2C' then 0 else least(greatest(coalesce({D}, 0), 0), 1) end + 0.0 as Discount,
  Total_Price, try_cast(Order_Date as timestamp) as Order_Date from dirty) f"""))
def apply_all_fixes(spark, sf):
    return quality.apply_all_fixes(views.sales_dirty(spark, sf))


# Features -----------------------------------------------------------------------------------

INTS = ["order_count", "customer_count"]
DOUBLES = [c for c in sql.BASE if c not in INTS]
FULL_DOUBLES = [c for c in sql.FULL if c not in INTS]
FEATURE_SQL = "select " + sql.show(
    [*KEYS, *INTS, *sql.CALENDAR, *sql.FLAGS], [*DOUBLES, *sql.ROLLING_COLUMNS, *sql.DEVIATIONS, *sql.TARGETS])


@query("densify_days", using("dense", f"select {sql.show([*KEYS, *INTS], DOUBLES)} from dense"))
def densify_days(spark, sf):
    return tidy(views.dense(spark, sf))


@query("rolling_features", using("rolled", f"select {sql.show(KEYS, sql.ROLLING_COLUMNS)} from rolled"))
def rolling_features(spark, sf):
    return tidy(features.add_rolling(views.dense(spark, sf)).select(*KEYS, *sql.ROLLING_COLUMNS))


@query("deviation_features", using("deviated", f"select {sql.show(KEYS, sql.DEVIATIONS)} from deviated"))
def deviation_features(spark, sf):
    return tidy(features.add_rolling(views.dense(spark, sf)).select(*KEYS, *sql.DEVIATIONS))


@query("future_targets", using("framed", f"select {sql.show(KEYS, sql.TARGETS)} from framed"))
def future_targets(spark, sf):
    return tidy(features.add_future_targets(views.dense(spark, sf)).select(*KEYS, *sql.TARGETS))


@query("history_flags", using("framed", f"select {', '.join(KEYS + sql.FLAGS)} from framed"))
def history_flags(spark, sf):
    return features.add_history_flags(views.dense(spark, sf)).select(*KEYS, *sql.FLAGS)


@query("fill_initial_nulls", using("features", f"select {sql.show(KEYS, sql.ROLLING_COLUMNS + sql.DEVIATIONS)} from features"))
def fill_initial_nulls(spark, sf):
    filled = features.fill_initial_nulls(features.add_rolling(views.dense(spark, sf)))
    return tidy(filled.select(*KEYS, *sql.ROLLING_COLUMNS, *sql.DEVIATIONS))


@query("fix_missing_feature_values", using("features", f"select {sql.show(KEYS, sql.DEVIATIONS)} from features"))
def fix_missing_feature_values(spark, sf):
    filled = features.fill_initial_nulls(features.add_rolling(views.dense(spark, sf)))
    return tidy(filled.select(*KEYS, *sql.DEVIATIONS))


@query("build_all_features", using("features", FEATURE_SQL + " from features"))
def build_all_features(spark, sf):
    return tidy(views.features(spark, sf))


@query("rebuild_calendar", using("framed", f"select {', '.join(KEYS + sql.CALENDAR)} from framed"))
def rebuild_calendar(spark, sf):
    return features.rebuild_calendar(add_calendar(views.dense(spark, sf))).select(*KEYS, *sql.CALENDAR)


@query("rebuild_rolling", using("features", f"select {sql.show(KEYS, sql.ROLLING_COLUMNS)} from features"))
def rebuild_rolling(spark, sf):
    return tidy(features.rebuild_rolling(views.dense(spark, sf)).select(*KEYS, *sql.ROLLING_COLUMNS))


@query("rebuild_flags", using("framed", f"select {', '.join(KEYS + sql.FLAGS)} from framed"))
def rebuild_flags(spark, sf):
    return features.rebuild_flags(views.dense(spark, sf)).select(*KEYS, *sql.FLAGS)


# The wide set -------------------------------------------------------------------------------

WIDE_GROUP = ("Product", "Region")
WIDE = [(m, s, w) for w in (7, 14, 30) for m in WIDE_METRICS for s in ("mean", "std", "sum")]
WIDE_COLUMNS = [f"{m}_{s}_{w}d" for m, s, w in WIDE]
WIDE_VS = [(f"{a}_vs_mean_{w}d", m, f"{m}_mean_{w}d") for w in (7, 14, 30) for a, m in WIDE_DEVIATIONS]
WIDE_PCT = [f"quantity_pct_vs_mean_{w}d" for w in (7, 14, 30)]


def _wide_sql(group, body):
    g = ", ".join(group)
    rolled = "select *, " + ", ".join(
        (f"coalesce({sql.past(m, s, w, g)}, 0)" if s == "std" else sql.past(m, s, w, g)) + f" as {m}_{s}_{w}d"
        for m, s, w in WIDE) + " from wd"
    wide = "select *, " + ", ".join(f"{m} - {mean} as {n}" for n, m, mean in WIDE_VS) + ", " + ", ".join(
        f"case when coalesce(quantity_sum_mean_{w}d, 0) <> 0 then (quantity_sum - quantity_sum_mean_{w}d) "
        f"/ quantity_sum_mean_{w}d end as quantity_pct_vs_mean_{w}d" for w in (7, 14, 30)) + " from wr"
    return using("sales", body + " from w", f=sql.daily(group, sql.FULL_EXTRA),
                 wd=sql.dense("f", group, sql.FULL), wr=rolled, w=wide)


WIDE_KEYS = [*WIDE_GROUP, "Order_Date"]


@query("data_features", _wide_sql(WIDE_GROUP, "select " + sql.show(
    [*WIDE_KEYS, *INTS], [*FULL_DOUBLES, *WIDE_COLUMNS, *[n for n, _, _ in WIDE_VS], *WIDE_PCT])
    + f", {sql.CALENDAR_SQL}, cast(day(Order_Date) as int) as day"))
def data_features(spark, sf):
    return tidy(features.build_wide_features(views.sales(spark, sf), group_cols=WIDE_GROUP))


def _wide(spark, sf, columns):
    return tidy(features.build_wide_features(views.sales(spark, sf)).select(*KEYS, *columns))


GROUP2 = ("Product", "Region")


@query("rolling_features_full", _wide_sql(WIDE_GROUP, "select " + sql.show(WIDE_KEYS, WIDE_COLUMNS)))
def rolling_features_full(spark, sf):
    daily = features.daily_metrics(views.sales(spark, sf), WIDE_GROUP, full=True)
    rolled = features.add_wide_rolling(fill_missing_days(daily, WIDE_GROUP), WIDE_GROUP)
    return tidy(rolled.select(*WIDE_KEYS, *WIDE_COLUMNS))


@query("deviation_features_full", _wide_sql(GROUP2, "select " + sql.show(KEYS, [n for n, _, _ in WIDE_VS])))
def deviation_features_full(spark, sf):
    return _wide(spark, sf, [n for n, _, _ in WIDE_VS])


@query("pct_features_full", _wide_sql(GROUP2, "select " + sql.show(KEYS, WIDE_PCT)))
def pct_features_full(spark, sf):
    return _wide(spark, sf, WIDE_PCT)


# Feature quality ----------------------------------------------------------------------------

UNFILLED = [*sql.ROLLING_COLUMNS, *sql.DEVIATIONS]
# The texts of the feature rules.
FQ = f"""
select 0 as no, 'Missing Derived Feature Values' as rule_name, 'High' as severity,
 'Apply fix_missing_feature_values().' as recommendation,
 cast((select {' + '.join(f'(count(*) - count({c}))' for c in UNFILLED)} from framed) as bigint) as issue_count
union all select 1, 'Negative Aggregated Metrics', 'Medium',
 'Review raw transactional data before feature generation.',
 cast((select {' + '.join(f'count(case when {c} < 0 then 1 end)' for c in NON_NEGATIVE)} from framed) as bigint)
union all select 2, 'Invalid Calendar Features', 'Low', 'Rebuild calendar features from parsed Order_Date.',
 cast((select count(case when day_of_week not between 0 and 6 then 1 end) + count(case when month not between 1 and 12 then 1 end)
  + count(case when is_weekend not in (0, 1) then 1 end) from framed) as bigint)
"""


def _unfilled(spark, sf):
    """Features before their initial nulls are filled, so that the rules have something to find."""
    return features.add_rolling(add_calendar(views.dense(spark, sf)))


def _feature_rule_query(key):
    name = feature_quality.FEATURE_RULES[key].name

    @query(f"fq_{key}", using("framed", _report(", recommendation") + f" from c where rule_name = '{name}'", c=FQ))
    def run(spark, sf):
        return feature_quality.feature_rule_report(_unfilled(spark, sf), key)


for _key in feature_quality.FEATURE_RULES:
    _feature_rule_query(_key)


@query("fq_report", using("framed", _report(" from c"), c=FQ))
def fq_report(spark, sf):
    return feature_quality.feature_quality_report(_unfilled(spark, sf))


@query("fq_executive_summary", using("framed", _summary("Feature Quality Executive Summary", 32, "c"), c=FQ))
def fq_executive_summary(spark, sf):
    return feature_quality.feature_executive_summary(_unfilled(spark, sf))
