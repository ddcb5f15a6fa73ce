import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import calendar, coerce
from ledgerlens.functions.statistics import error_metrics, signal_statistics


def one(df):
    return [tuple(r) for r in df.collect()]


def test_safe_numeric_reads_numbers_only(spark):
    df = spark.createDataFrame([(x,) for x in ("5", " 5 ", "-3.5", "1e3", "abc", "1d", "1f", "0x1p3", "", None, "NaN")], "a string")
    got = [r[0] for r in df.select(coerce.safe_numeric(df, "a")).collect()]
    assert got == [5.0, 5.0, -3.5, 1000.0, None, None, None, None, None, None, None]
    inf = spark.createDataFrame([("inf",), ("-Infinity",)], "a string")
    assert [r[0] for r in inf.select(coerce.safe_numeric(inf, "a")).collect()] == [math.inf, -math.inf]


def test_safe_datetime_with_formats(spark):
    df = spark.createDataFrame([("2022-05-03",), ("03/05/2022",), ("bad",), (None,)], "a string")
    got = [r[0] for r in df.select(coerce.safe_datetime(df, "a", ["dd/MM/yyyy"])).collect()]
    assert got == [datetime(2022, 5, 3), datetime(2022, 5, 3), None, None]
    assert one(df.select(coerce.safe_date(df, "a")))[0] == (date(2022, 5, 3),)


def test_clip_finite_and_rounding(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (9.0,), (math.inf,), (math.nan,)], "x double")
    assert one(df.select(coerce.clip(coerce.finite(F.col("x")), -5, 5))) == [(None,), (-5.0,), (5.0,), (None,), (None,)]
    halves = spark.createDataFrame([(0.125,), (0.375,), (2.675,), (-0.125,)], "x double")
    assert one(halves.select(coerce.round_half_even(F.col("x")))) == [(0.12,), (0.38,), (2.68,), (-0.12,)] or \
        one(halves.select(coerce.round_half_even(F.col("x")))) == [(0.12,), (0.38,), (2.67,), (-0.12,)]


def test_nan_becomes_null_on_entry(spark):
    df = coerce.nan_to_null(spark.createDataFrame([(1, math.nan), (2, 3.0)], "k int, x double"))
    assert df.where("x is null").count() == 1


def test_period_labels(spark):
    df = spark.createDataFrame([(date(2022, 5, 3),), (date(2022, 7, 1),), (None,)], "Order_Date date")
    got = one(calendar.add_period_labels(df).select("YearMonth", "Quarter", "Semester", "Year"))
    assert got == [("2022-05", "2022Q2", "2022-S1", "2022"), ("2022-07", "2022Q3", "2022-S2", "2022"), (None,) * 4]
    with pytest.raises(ValueError):
        calendar.period_label(F.col("Order_Date"), "week")


def test_calendar_and_file_names(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 7),)], "Order_Date date")
    assert one(calendar.add_calendar(df).select("day_of_week", "is_weekend")) == [(0, 0), (6, 1)]
    names = spark.createDataFrame([("2003.10.22.12.06.24",), (".DS_Store",)], "n string")
    assert one(names.select(calendar.timestamp_from_name(F.col("n")))) == [(datetime(2003, 10, 22, 12, 6, 24),), (None,)]


def test_error_metrics_of_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    exprs = [e.alias(n) for n, e in error_metrics(F.col("y"), F.col("p")).items()]
    assert df.agg(*exprs).first().asDict() == {"mae": 0.5, "rmse": pytest.approx(math.sqrt(0.5)), "r2": 0.0}
    assert df.where("y = p").agg(*exprs).first()["r2"] == 1.0


def test_signal_statistics_of_zero_signal(spark):
    stats = spark.createDataFrame([(0.0,), (0.0,)], "value double").agg(
        *[e.alias(n) for n, e in signal_statistics(F.col("value")).items()]).first()
    assert stats["rms"] == 0 and stats["shape_factor"] is None
