from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import feature_quality, features
from ledgerlens.operators.daily import daily_metrics, fill_missing_days

COLUMNS = ("Order_ID long, Customer_ID long, Customer_Type string, Product string, Category string, "
           "Unit_Price double, Quantity double, Discount double, Total_Price double, Region string, Order_Date string")


def sale(order, product, region, day, quantity=1.0, price=2.0):
    return (order, order % 3, "B2B", product, "C", price, quantity, 0.0,
            None if quantity is None else price * quantity, region, day)


@pytest.fixture(scope="module")
def random_sales():
    rng = np.random.default_rng(5)
    days = pd.date_range("2022-01-01", "2022-04-30")
    return [sale(i, rng.choice(["p", "q"]), rng.choice(["n", "s"]), str(rng.choice(days))[:10],
                 float(rng.integers(0, 9)), float(rng.integers(100, 900)) / 100) for i in range(400)]


def test_gaps_are_filled_within_each_group(spark):
    df = spark.createDataFrame([
        sale(1, "p", "n", "2022-01-01"), sale(2, "p", "n", "2022-01-11"), sale(3, "q", "n", "2022-01-05"),
        sale(4, None, "n", "2022-01-05"), sale(5, "p", "n", "nonsense"), sale(6, "p", "n", None)], COLUMNS)
    days = fill_missing_days(daily_metrics(df)).orderBy("Product", "Order_Date").collect()
    assert [r["Order_Date"].day for r in days if r["Product"] == "p"] == list(range(1, 12))
    assert [r["quantity_sum"] for r in days if r["Product"] == "p"] == [1.0] + [0.0] * 9 + [1.0]
    assert [r["order_count"] for r in days if r["Product"] == "q"] == [1]
    assert {r["Product"] for r in days} == {"p", "q"}


def test_missing_measures(spark):
    df = spark.createDataFrame([sale(1, "p", "n", "2022-01-01", None), sale(2, "p", "n", "2022-01-03", 4.0)], COLUMNS)
    first = daily_metrics(df, full=True).orderBy("Order_Date").first()
    assert first["quantity_sum"] == 0.0 and first["quantity_mean"] is None and first["quantity_std"] == 0.0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Region"):
        daily_metrics(spark.createDataFrame([], COLUMNS).drop("Region"))


def test_empty_input(spark):
    assert features.build_features(spark.createDataFrame([], COLUMNS)).count() == 0


def _expected(rows):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    pdf["Order_Date"] = pd.to_datetime(pdf["Order_Date"])
    parts = []
    for key, g in pdf.groupby(["Product", "Region"]):
        d = g.groupby("Order_Date").agg(q=("Quantity", "sum"), t=("Total_Price", "sum"), u=("Unit_Price", "mean"))
        d = d.reindex(pd.date_range(d.index.min(), d.index.max())).fillna(0.0)
        past = d.shift(1)
        out = pd.DataFrame({
            "quantity_sum": d.q, "quantity_sum_mean_7d": past.q.rolling(7, min_periods=1).mean(),
            "quantity_sum_std_7d": past.q.rolling(7, min_periods=1).std(),
            "total_price_sum_mean_30d": past.t.rolling(30, min_periods=1).mean(),
            "unit_price_mean_mean_7d": past.u.rolling(7, min_periods=1).mean(),
            "quantity_sum_next_14d": [d.q.iloc[i + 1:i + 15].sum() if i + 1 < len(d) else np.nan for i in range(len(d))],
            "history_less_than_7d": (np.arange(len(d)) < 7).astype(int)}, index=d.index)
        mean = out.quantity_sum_mean_7d
        out["quantity_pct_vs_mean_7d"] = ((d.q - mean) / mean).where(mean.fillna(0) != 0)
        fill = [c for c in features.DERIVED_COLUMNS if c in out]
        out[fill] = out[fill].fillna(0.0)
        parts.append(out.assign(Product=key[0], Region=key[1]).rename_axis("Order_Date").reset_index())
    return pd.concat(parts)


def test_features_match_plain_pandas(spark, random_sales):
    want = _expected(random_sales)
    got = features.build_features(spark.createDataFrame(random_sales, COLUMNS)).toPandas()
    keys = ["Product", "Region", "Order_Date"]
    got["Order_Date"] = pd.to_datetime(got["Order_Date"])
    both = want.merge(got, on=keys, suffixes=("_want", "_got"), how="outer")
    assert len(both) == len(want) == len(got)
    for c in want.columns.drop(keys):
        assert np.allclose(both[f"{c}_want"].astype(float), both[f"{c}_got"].astype(float), equal_nan=True), c


def test_wide_features_respect_min_periods(spark, random_sales):
    df = spark.createDataFrame(random_sales, COLUMNS)
    wide = features.build_wide_features(df, windows=(7,), min_periods=3)
    number = F.row_number().over(features._days(("Product", "Region"), "Order_Date"))
    early = wide.withColumn("n", number).where("n <= 3")
    assert early.where("quantity_sum_mean_7d is not null").count() == 0
    assert early.where("quantity_sum_std_7d <> 0").count() == 0
    assert wide.withColumn("n", number).where("n > 3 and quantity_sum_mean_7d is null").count() == 0
    assert len(features.build_wide_features(df).columns) == 3 + 10 + 5 + 54 + 12 + 3


def test_features_use_few_shuffles_and_no_python(spark, random_sales):
    built = features.build_features(spark.createDataFrame(random_sales, COLUMNS))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3  # two for the distinct counts, one by group for every window
    assert "Python" not in plan
    assert plan.count("Window [") == 2  # one to fill days, one for all features


def test_feature_quality_report(spark):
    row = {c: 1.0 for c in features.DERIVED_COLUMNS}
    good = {**row, "quantity_sum": 1.0, "day_of_week": 0, "month": 1, "is_weekend": 0}
    bad = {**row, "quantity_sum": -1.0, "day_of_week": 9, "month": 0, "is_weekend": 2, "quantity_sum_mean_7d": None}
    report = {r["rule_name"]: r["issue_count"] for r in
              feature_quality.feature_quality_report(spark.createDataFrame([good, bad])).collect()}
    assert list(report.values()) == [1, 1, 3]
    text = feature_quality.feature_executive_summary(spark.createDataFrame([good, good])).first()[0]
    assert "No high-severity issues were detected" in text


def test_rebuild_steps(spark, random_sales):
    built = features.build_features(spark.createDataFrame(random_sales, COLUMNS))
    broken = built.withColumns({"month": F.lit(0), "quantity_sum_mean_7d": F.lit(None).cast("double"),
                                "history_less_than_7d": F.lit(5)})
    again = features.rebuild_flags(features.rebuild_rolling(features.rebuild_calendar(broken)))
    assert again.select(*built.columns).exceptAll(built).count() == 0
    assert built.agg(F.min("Order_Date")).first()[0] >= date(2022, 1, 1)


def test_tasks_over_sales_do_not_grow_with_the_table(spark, monkeypatch):
    """A task counted the distinct orders of a whole split of 128 MB, and spilled."""
    from ledgerlens import session
    from workload import registry, views

    names = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    monkeypatch.setattr(session, "ROWS_PER_TASK", 300)
    registry._MADE.clear()
    try:
        sales = views.sales(spark, "/root/testdata/sf0.001")
        rows = [r["n"] for r in sales.groupBy(F.col("_metadata.file_path")).agg(F.count("Order_ID").alias("n")).collect()]
        assert max(rows) <= 300 and sum(rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        assert int(spark.conf.get(names[0])) >= sum(rows) / 300 and int(spark.conf.get(names[1])) >= sum(rows) / 300
    finally:
        registry._MADE.clear()
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_sales_are_summed_once_and_feature_rows_rounded_before_the_join(spark):
    """Five regions and both sides of an alignment read the sales each; every sale was rounded in 24 columns."""
    from workload import tables

    sf = "/root/testdata/sf0.001"
    plan = lambda query: query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Order_ID" not in plan(tables.union_groups) and "Order_ID" not in plan(tables.join_align_positional)
    above = plan(tables.join_features_to_sales).split("Join LeftOuter")[0]
    assert "round(" not in above and "round(" in plan(tables.join_features_to_sales)
