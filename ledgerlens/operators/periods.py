"""Distribution of a measure per calendar period, and monthly product totals.

The number of periods is bounded by the calendar, so tables with one row per period are safe to
broadcast; the sales behind them are never gathered per period.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.calendar import PERIODS, add_year_month, period_label
from ledgerlens.functions.coerce import safe_numeric
from ledgerlens.operators.filters import by_year_category, select_measure
from ledgerlens.operators.outliers import iqr_limits
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.session import materialise
from ledgerlens.schema import DATE, require_columns

GRID_POINTS = 100
WHISKER = 1.5


def _period_values(df, value_col, period, filters, start, end, date_col) -> DataFrame:
    """(period label, value) of the rows that carry a value."""
    label = PERIODS.get(period)
    if label is None:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    rows = select_measure(df, value_col, filters, start, end, date_col)
    return rows.select(
        period_label(F.col(date_col), period).alias(label), safe_numeric(rows, value_col).alias("value"),
    ).where(F.col("value").isNotNull())


def period_distribution(
    df: DataFrame, value_col: str, period: str = "quarter", filters: Mapping[str, object] | None = None,
    start=None, end=None, date_col: str = DATE,
) -> DataFrame:
    """Box statistics per period: n, min, q1, median, q3, max, whiskers and number of fliers.

    Whiskers end at the furthest values within 1.5 interquartile ranges of the box.
    """
    rows = materialise(_period_values(df, value_col, period, filters, start, end, date_col))
    label = PERIODS[period]
    boxes = exact_quantiles(
        rows, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [label], bounded_groups=True)
    low, high = iqr_limits(F.col("q1"), F.col("q3"), WHISKER)
    v = F.col("value")
    inside = (v >= low) & (v <= high)
    below_box, above_box = F.col("q1"), F.col("q3")
    return (
        rows.join(F.broadcast(boxes), label)
        .groupBy(label, "q1", "median", "q3")
        .agg(
            F.count(v).alias("n"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            # The box itself is the whisker where no value lies between it and the fence.
            F.least(F.min(F.when(inside, v)), F.first(below_box)).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, v)), F.first(above_box)).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("fliers"),
        )
    )


def _kernel_sums(grid: np.ndarray, values: np.ndarray, copies: np.ndarray, width: float | None) -> np.ndarray:
    """Sum of the Gaussian kernels of all values at each grid point; without a width, of the values that lie on it."""
    if not width or width != width:
        return ((grid[:, None] == values[None, :]) * copies).sum(axis=1).astype(float)
    out = np.zeros(len(grid))
    for start in range(0, len(values), 4096):
        distance = (grid[:, None] - values[None, start:start + 4096]) / width
        out += np.exp(-0.5 * distance * distance) @ copies[start:start + 4096]
    return out


def period_density(
    df: DataFrame, value_col: str, period: str = "year", filters: Mapping[str, object] | None = None,
    start=None, end=None, date_col: str = DATE, points: int = GRID_POINTS, log_scale: bool = False,
) -> DataFrame:
    """Gaussian kernel density per period on an even grid from its minimum to its maximum.

    The bandwidth is Scott's: n^(−1/5) sample standard deviations. Each row also carries the
    period's median. A period with one distinct value has density 1 at that value. `log_scale`
    adds the base-10 logarithm of the grid value, null where it is not positive.
    """
    rows = materialise(_period_values(df, value_col, period, filters, start, end, date_col))
    label = PERIODS[period]
    medians = exact_quantiles(rows, "value", {"median": 0.5}, [label], bounded_groups=True)
    shapes = rows.groupBy(label).agg(
        F.count("value").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"),
        F.stddev_samp("value").alias("_std"),
    ).join(F.broadcast(medians), label)
    step = (F.col("_high") - F.col("_low")) / (points - 1)
    shapes = materialise(shapes.select(
        label, "median", "_n", "_low", step.alias("_step"),
        (F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_width")))
    # Every batch gives one partial sum per grid point of each period it holds; a kernel is evaluated once
    # per distinct value of the batch, and the sums meet in a plain aggregation.
    spark = df.sparkSession
    frames = spark.sparkContext.broadcast({  # one row per calendar period
        r[label]: (r["_low"], r["_step"], r["_width"]) for r in shapes.select(label, "_low", "_step", "_width").collect()})
    kind = rows.schema[label].dataType.simpleString()

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses: dict[object, np.ndarray] = {}
        for batch in batches:
            pairs = pa.Table.from_batches([batch]).group_by([label, "value"]).aggregate([([], "count_all")])
            for period in pairs[label].unique().to_pylist():
                low, step, width = frames.value[period]
                own = pairs.filter(pc.equal(pairs[label], period))
                grid = low + step * np.arange(points)
                masses[period] = masses.get(period, 0) + _kernel_sums(
                    grid, own["value"].to_numpy(), own["count_all"].to_numpy(), width)
        for period, mass in masses.items():
            yield pa.RecordBatch.from_pydict({label: [period] * points, "point": pa.array(range(points), pa.int32()), "_mass": mass})

    sums = rows.select(label, "value").mapInArrow(partial_sums, f"`{label}` {kind}, point int, _mass double")
    norm = F.when(F.col("_width") > 0, F.col("_n") * F.col("_width") * math.sqrt(2 * math.pi)).otherwise(F.col("_n"))
    out = (
        sums.groupBy(label, "point").agg(F.sum("_mass").alias("_mass")).join(F.broadcast(shapes), label)
        .select(label, "point", (F.col("_low") + F.col("_step") * F.col("point")).alias("grid_value"),
                (F.col("_mass") / norm).alias("density"), "median")
    )
    if log_scale:
        out = out.withColumn("log_value", F.when(F.col("grid_value") > 0, F.log10("grid_value")))
    return out


def monthly_product_quantity(
    features: DataFrame, year, category, month=None, product=None,
) -> DataFrame:
    """Quantity per month, category and product, in that order."""
    require_columns(features, ["Product", "Region", "Category", "quantity_sum", "month", "year"])
    kept = by_year_category(features, year, category, month, product)
    keys = ["year_month", "year_month_label", "Category", "Product"]
    return (
        add_year_month(kept).groupBy(*keys)
        .agg(F.coalesce(F.sum("quantity_sum"), F.lit(0.0)).alias("quantity_sum"))
        .orderBy("year_month", "Category", "Product")
    )


def monthly_product_pivot(monthly: DataFrame, products: Sequence[str]) -> DataFrame:
    """One row per month, one column per product, zero where a product was not sold."""
    return (
        monthly.groupBy("year_month_label").pivot("Product", list(products)).agg(F.sum("quantity_sum"))
        .fillna(0.0, subset=list(products)).orderBy("year_month_label")
    )
