import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import filters, ordered, outliers, periods
from ledgerlens.operators.evaluation import one_step_ahead


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    days = pd.date_range("2021-11-01", periods=120)
    frame = pd.DataFrame({"Order_Date": rng.choice(days, 600), "Region": rng.choice(["n", "s"], 600),
                          "Quantity": rng.integers(1, 30, 600).astype(float)})
    frame.loc[5, "Quantity"] = 900.0
    frame.loc[::50, "Quantity"] = np.nan
    return frame


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table.assign(Order_Date=table["Order_Date"].dt.strftime("%Y-%m-%d")))


@pytest.mark.parametrize("agg", ["sum", "mean", "median", "count"])
def test_daily_series(df, table, agg):
    got = outliers.daily_series(df, "Quantity", agg, {"Region": "n"}).toPandas().sort_values("Order_Date")
    want = table[table["Region"] == "n"].dropna().groupby("Order_Date")["Quantity"].agg(agg)
    assert np.allclose(got["Quantity"], want)


@pytest.mark.parametrize("method,window", [("iqr", None), ("zscore", None), ("iqr", 5), ("zscore", 5), ("iqr", 1)])
def test_bands(df, table, method, window):
    got = outliers.outliers_by_period(df, "Quantity", method=method, moving_window=window).toPandas()
    got = got.sort_values("Order_Date")
    y = table.dropna().groupby("Order_Date")["Quantity"].sum().reset_index(drop=True)
    over = y.rolling(window, min_periods=1) if window and window > 1 else None
    if method == "iqr":
        q1, mid, q3 = [(over or y).quantile(p) for p in (0.25, 0.5, 0.75)]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    else:
        mid, sd = (over or y).mean(), (over or y).std()
        sd = sd.fillna(0) if over is not None else sd
        low, high = mid - 3 * sd, mid + 3 * sd
    assert np.allclose(got["lower_limit"], low) and np.allclose(got["upper_limit"], high)
    assert np.allclose(got["reference"], mid)
    assert got["is_outlier"].tolist() == ((y < low) | (y > high)).tolist()


def test_moving_quartiles_equal_each_window_on_its_own():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400), 1)
    x[rng.random(400) < 0.2] = np.nan
    x[50:70] = np.nan
    x[100], x[200] = np.inf, -1e300
    for window in (2, 7, 30, 1000):
        got = outliers._moving_quartiles(x, window)
        for i in range(len(x)):
            seen = x[max(0, i - window + 1):i + 1]
            seen = seen[~np.isnan(seen)]
            if not len(seen):
                assert np.isnan(got[i]).all()
            elif np.isfinite(seen).all():
                assert np.allclose(got[i], np.quantile(seen, outliers.QUARTILES), rtol=1e-12)


def test_a_long_window_costs_little_more_than_a_short_one():
    x = np.random.default_rng(4).normal(size=100_000)

    def seconds(window):
        best = np.inf
        for _ in range(3):
            start = time.process_time()
            outliers._moving_quartiles(x, window)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(1000) <= 2 * seconds(30)


def test_moving_bands_run_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(outliers, "in_blocks", lambda df, before, after: ordered.in_blocks(df, before, after, rows=37))
    rng = np.random.default_rng(5)
    y = pd.Series(np.where(rng.random(300) < 0.1, np.nan, rng.normal(size=300)))
    rows = [(i, None if np.isnan(v) else float(v), "x") for i, v in enumerate(y)]
    series = spark.createDataFrame(rows, "day int, v double, kept string").repartition(5)
    got = outliers.rolling_band(series, "v", 90, date_col="day").toPandas().sort_values("day")
    over = y.rolling(90, min_periods=1)
    assert list(got.columns) == ["day", "v", "kept", "lower_limit", "upper_limit", "reference", "is_outlier"]
    assert len(got) == 300 and np.allclose(got["reference"], over.quantile(0.5), equal_nan=True)
    assert np.allclose(got["upper_limit"], over.quantile(0.75) + 1.5 * (over.quantile(0.75) - over.quantile(0.25)), equal_nan=True)


def test_bad_arguments(df):
    for call in (lambda: outliers.daily_series(df, "Quantity", "max"), lambda: outliers.global_band(df, "Quantity", "x"),
                 lambda: periods.period_distribution(df, "Quantity", "week"),
                 lambda: outliers.daily_series(df, "Missing"), lambda: filters.membership(df, {"nope": 1})):
        with pytest.raises(ValueError):
            call()


def test_no_rows_left(df):
    assert outliers.outliers_by_period(df, "Quantity", {"Region": "nowhere"}).count() == 0
    assert outliers.outliers_by_period(df, "Quantity", {"Region": "nowhere"}, moving_window=7).count() == 0
    assert periods.period_distribution(df, "Quantity", "year", {"Region": "nowhere"}).count() == 0


def test_filters(df):
    assert filters.date_range(filters.parse_dates(df), "2021-12-01", "2021-12-31").agg(
        F.min("Order_Date"), F.max("Order_Date")).first()[0].month == 12
    with pytest.raises(ValueError):
        filters.by_group_value(df, "Quantity", "Region")
    with pytest.raises(ValueError):
        filters.by_year_category(df, None, "x")
    assert filters.columns_matching(df, "^Order.*").columns == ["Order_Date"]


def test_end_date_is_its_midnight(spark):
    rows = spark.sql("select timestamp_ntz'2022-01-01 00:00:00' as Order_Date union all select timestamp_ntz'2022-01-01 08:00:00'")
    assert filters.date_range(rows, "2022-01-01", "2022-01-01").count() == 1


def test_period_distribution(df, table):
    got = periods.period_distribution(df, "Quantity", "month").toPandas().sort_values("YearMonth")
    x = table.dropna()
    for r, (_, g) in zip(got.itertuples(), x.groupby(x["Order_Date"].dt.strftime("%Y-%m"))["Quantity"]):
        q1, mid, q3 = g.quantile([0.25, 0.5, 0.75])
        inside = g[(g >= q1 - 1.5 * (q3 - q1)) & (g <= q3 + 1.5 * (q3 - q1))]
        assert (r.n, r.q1, r.median, r.q3) == (len(g), q1, mid, q3)
        assert (r.whisker_low, r.whisker_high, r.fliers) == (min(inside.min(), q1), max(inside.max(), q3), len(g) - len(inside))


def test_density_integrates_to_one_and_handles_constants(spark, df):
    d = periods.period_density(df.where("Quantity < 100"), "Quantity", "year").toPandas()
    for _, g in d.groupby("Year"):
        g = g.sort_values("grid_value")
        assert len(g) == 100 and 0.75 < np.trapezoid(g["density"], g["grid_value"]) <= 1.0
    flat = spark.createDataFrame([("2020-01-01", 4.0), ("2020-02-01", 4.0)], "Order_Date string, Quantity double")
    assert set(periods.period_density(flat, "Quantity", "year").toPandas()["density"]) == {1.0}


def test_monthly_pivot(spark):
    rows = [("p", "r", "c", 3.0, 1, 2022), ("q", "r", "c", 4.0, 2, 2022), ("p", "r", "x", 9.0, 1, 2022)]
    feats = spark.createDataFrame(rows, "Product string, Region string, Category string, quantity_sum double, month int, year int")
    monthly = periods.monthly_product_quantity(feats, 2022, "c")
    got = [tuple(r) for r in periods.monthly_product_pivot(monthly, ["p", "q"]).collect()]
    assert got == [("2022-01", 3.0, 0.0), ("2022-02", 0.0, 4.0)]


def test_one_step_ahead_of_a_line_is_exact(spark):
    series = spark.range(20).select(
        F.expr("timestamp_ntz'2022-01-01' + make_dt_interval(int(id))").alias("Order_Date"), (F.col("id") * 3.0).alias("q"))
    got = one_step_ahead(series, "q", "2022-01-10").toPandas()
    assert len(got) == 10 and np.allclose(got["prediction"], got["actual"])
