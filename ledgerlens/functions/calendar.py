"""Calendar columns and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted period names and the label column each one stands for.
PERIODS = {"month": "YearMonth", "quarter": "Quarter", "semester": "Semester", "year": "Year"}


def weekday(c: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(c).cast("int")


def add_calendar(df: DataFrame, date_col: str = "Order_Date", with_day: bool = False) -> DataFrame:
    """day_of_week, month, year and is_weekend, and the day of the month on request."""
    d = F.col(date_col)
    columns = {
        "day_of_week": weekday(d),
        "month": F.month(d).cast("int"),
        "year": F.year(d).cast("int"),
        "is_weekend": weekday(d).isin(5, 6).cast("int"),
    }
    if with_day:
        columns["day"] = F.dayofmonth(d).cast("int")
    return df.withColumns(columns)


def period_label(c: Column, period: str) -> Column:
    """`2022-05`, `2022Q2`, `2022-S1` or `2022`."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    if period == "month":
        return F.date_format(c, "yyyy-MM")
    year = F.date_format(c, "yyyy")
    if period == "quarter":
        return F.concat(year, F.lit("Q"), F.quarter(c).cast("string"))
    if period == "semester":
        return F.concat(year, F.when(F.month(c) <= 6, "-S1").when(F.month(c) > 6, "-S2"))
    return year


def add_period_labels(df: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    return df.withColumns({name: period_label(F.col(date_col), p) for p, name in PERIODS.items()})


def add_year_month(df: DataFrame) -> DataFrame:
    """First day of the month and its `YYYY-MM` label, from integer year and month columns."""
    first = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))
    return df.withColumns({"year_month": first, "year_month_label": F.date_format(first, "yyyy-MM")})


def flag_label(c: Column) -> Column:
    """0 is Normal, 1 is Anomalous, anything else is shown as text."""
    return F.when(c == 0, "Normal").when(c == 1, "Anomalous").otherwise(c.cast("string"))


def timestamp_from_name(c: Column) -> Column:
    """Timestamp written in a file name as `2003.10.22.12.06.24`, null for any other name."""
    return F.try_to_timestamp(c, F.lit("yyyy.MM.dd.HH.mm.ss")).cast("timestamp_ntz")
