"""Row filters and column selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.coerce import safe_date, safe_datetime
from ledgerlens.schema import DATE, as_list, require_columns


def membership(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Keep rows whose column value is among the given ones, for every entry.

    A value may be one item or a collection; None leaves that column unfiltered.
    """
    filters = filters or {}
    require_columns(df, filters)
    for column, values in filters.items():
        wanted = as_list(values)
        if wanted is not None:
            df = df.where(F.col(column).isin(wanted))
    return df


def _moment(value: str | date | datetime):
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else F.lit(value)


def date_range(df: DataFrame, start=None, end=None, date_col: str = DATE) -> DataFrame:
    """Keep `start` ≤ date ≤ `end`; an `end` without a time of day means its midnight."""
    require_columns(df, [date_col])
    if start is not None:
        df = df.where(F.col(date_col) >= _moment(start))
    if end is not None:
        df = df.where(F.col(date_col) <= _moment(end))
    return df


def drop_invalid_dates(df: DataFrame, date_col: str = DATE, formats: Sequence[str] = ()) -> DataFrame:
    """Read the date, bring it to its day, drop rows without one."""
    require_columns(df, [date_col])
    return df.withColumn(date_col, safe_date(df, date_col, formats)).where(F.col(date_col).isNotNull())


def parse_dates(df: DataFrame, date_col: str = DATE, formats: Sequence[str] = ()) -> DataFrame:
    """Read the date as a timestamp, keeping its time of day, and drop rows without one."""
    require_columns(df, [date_col])
    return df.withColumn(date_col, safe_datetime(df, date_col, formats)).where(F.col(date_col).isNotNull())


def select_measure(
    df: DataFrame, value_col: str, filters: Mapping[str, object] | None = None,
    start=None, end=None, date_col: str = DATE,
) -> DataFrame:
    """Rows of a dated table that carry `value_col`, within the period and the filters."""
    require_columns(df, [value_col])
    kept = membership(date_range(parse_dates(df, date_col), start, end, date_col), filters)
    return kept.where(F.col(value_col).isNotNull())


def by_group_value(
    df: DataFrame, value_col: str, group_col: str | None = None, group_value=None,
    start=None, end=None, date_col: str = DATE,
) -> DataFrame:
    """`select_measure` for one value of one column; the two arguments go together."""
    if group_col is not None and group_value is None:
        raise ValueError("group_value is needed when group_col is given")
    return select_measure(df, value_col, {group_col: group_value} if group_col else None, start, end, date_col)


def by_product_region(df: DataFrame, product=None, region=None) -> DataFrame:
    wanted = {"Product": product, "Region": region}
    return membership(df, {c: v for c, v in wanted.items() if v is not None})


def by_year_category(df: DataFrame, year, category, month=None, product=None) -> DataFrame:
    """Year and category are mandatory, month and product optional."""
    if year is None or category is None:
        raise ValueError("year and category are mandatory")
    return membership(df, {"year": year, "Category": category, "month": month, "Product": product})


def by_year(df: DataFrame, years, date_col: str = DATE, year_col: str | None = None) -> DataFrame:
    """Rows of the given years, as date ranges so that the scan can skip row groups.

    For a table written by year, `year_col` names that column and whole folders are skipped too.
    """
    wanted = as_list(years)
    cond = F.lit(False)
    for y in wanted:
        cond = cond | ((F.col(date_col) >= F.lit(date(y, 1, 1))) & (F.col(date_col) < F.lit(date(y + 1, 1, 1))))
    return df.where(cond if year_col is None else cond & F.col(year_col).isin(wanted))


def split_by_year(
    df: DataFrame, train_years, test_years, date_col: str = DATE, year_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    return by_year(df, train_years, date_col, year_col), by_year(df, test_years, date_col, year_col)


def columns_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches a regular expression."""
    return df.select(df.colRegex(f"`{pattern}`"))
