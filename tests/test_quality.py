import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality

SCHEMA = ("Order_ID long, Customer_ID long, Customer_Type string, Product string, Category string, "
          "Unit_Price double, Quantity string, Discount string, Total_Price double, Region string, Order_Date string")


def row(i, kind="B2B", quantity="2", discount="0.1", total=None, day="2022-01-01"):
    total = 10.0 * 2 * 0.9 if total is None else total
    return (i, i, kind, "p", "c", 10.0, quantity, discount, total, "r", day)


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [row(1), row(1), row(1), row(2, quantity=None), row(3, quantity="x"), row(4, quantity="-1"),
            row(5, discount=None), row(6, discount="-0.5"), row(7, discount="3"), row(8, kind=None),
            row(9, kind="X"), row(10, kind="B2C"), row(11, day="never"), row(12, total=19.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_report_counts(dirty):
    got = {r["rule_name"]: (r["issue_found"], r["issue_count"]) for r in quality.quality_report(dirty).collect()}
    assert got == {
        "Missing Quantity": ("YES", 2), "Negative Quantity": ("YES", 1), "Missing Discount": ("YES", 1),
        "Negative Discount": ("YES", 1), "Discount Above One": ("YES", 1), "Invalid Customer Type": ("YES", 2),
        "B2C Discount Rule Violation": ("YES", 1), "Invalid Order Date": ("YES", 1),
        "Exact Duplicate Rows": ("YES", 2), "Total Price Consistency": ("YES", 5)}


def test_single_rules_agree_with_the_report(dirty):
    report = {r["rule_name"]: r["issue_count"] for r in quality.quality_report(dirty, 0.1).collect()}
    for key, rule in quality.RULES.items():
        assert quality.rule_report(dirty, key).first()["issue_count"] == report[rule.name]
    with pytest.raises(ValueError):
        quality.rule_report(dirty, "nothing")


def test_summary_text(dirty):
    text = quality.executive_summary(dirty).first()["summary"]
    assert "Rules evaluated: 10\nRules with issues found: 10\nTotal issue count: 17" in text
    assert "High-severity issues: Negative Quantity, Negative Discount," in text


def test_reports_on_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert {r["issue_count"] for r in quality.quality_report(empty).collect()} == {0}
    assert quality.duplicate_rows_count(empty).first()[0] == 0
    assert "No high-severity" in quality.executive_summary(empty).first()[0]


def test_fixes_leave_a_clean_table(dirty):
    fixed = quality.apply_all_fixes(dirty).where("Order_Date is not null and Customer_Type in ('B2B', 'B2C')")
    assert {r["issue_count"] for r in quality.quality_report(fixed).collect()} == {0}
    assert quality.apply_all_fixes(dirty).count() == dirty.distinct().count()


def test_rows_made_equal_by_fixes_are_merged(spark):
    df = spark.createDataFrame([row(1, discount=None), row(1, discount="0"), row(1, discount="-4")], SCHEMA)
    assert quality.apply_all_fixes(df).count() == 1
    assert quality.apply_all_fixes(df, recalc_total_price=False).first()["Total_Price"] == 18.0


def test_price_inconsistencies(dirty):
    got = quality.price_inconsistencies(dirty, n=3).collect()
    assert len(got) == 3 and got[0]["Diff"] == max(r["Diff"] for r in got)


def test_neighbor_mean(spark):
    values = [("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("a", 4, 8.0), ("a", 5, None), ("a", 6, None),
              ("a", 7, 1.0), ("b", 1, 2.0), ("b", 2, None), (None, 1, None)]
    df = spark.createDataFrame([(g, f"2022-01-{d:02d}", v) for g, d, v in values],
                               "g string, Order_Date string, Total_Price double").repartition(4)
    got = {(r["g"], r["Order_Date"].day): r["Total_Price"] for r in
           quality.fix_neighbor_mean(df, ["g"], unique_order=True).collect()}
    assert got == {("a", 1): None, ("a", 2): 4.0, ("a", 3): 6.0, ("a", 4): 8.0, ("a", 5): None, ("a", 6): None,
                   ("a", 7): 1.0, ("b", 1): 2.0, ("b", 2): None, (None, 1): None}


def test_neighbor_mean_keeps_every_copy(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), F.lit("2022-01-01").alias("Order_Date"),
                                  F.when(F.col("id") % 2 == 0, 5.0).alias("Total_Price"))
    filled = quality.fix_neighbor_mean(df, ["g"])
    assert filled.count() == 3000


def test_null_and_key_counts(dirty):
    assert quality.null_counts(dirty, ["Customer_Type", "Quantity"]).first().asDict() == {"Customer_Type": 1, "Quantity": 1}
    assert quality.duplicate_keys_count(dirty, ["Product", "Region"]).first()[0] == 13
