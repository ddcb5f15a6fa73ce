"""Column sets of the sales table and the checks made while a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

DATE = "Order_Date"
GROUP = ("Product", "Region")

# The eleven columns every sales table must carry.
SALES_COLUMNS = (
    "Order_ID", "Customer_ID", "Customer_Type", "Product", "Category",
    "Unit_Price", "Quantity", "Discount", "Total_Price", "Region", "Order_Date",
)

# Raw files are read as text so that a bad cell becomes a null later instead of failing the scan.
RAW_SALES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SALES_COLUMNS])


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ValueError naming every column of `columns` that `df` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def as_list(value) -> list | None:
    """None stays None, a scalar becomes a one-element list, any collection becomes a list."""
    if value is None:
        return None
    if isinstance(value, (list, tuple, set, frozenset)):
        return list(value)
    return [value]


def all_present(columns: Sequence[str]) -> Column:
    """True where none of `columns` is null."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond
