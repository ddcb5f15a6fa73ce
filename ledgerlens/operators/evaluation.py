"""Error metrics, comparison of two models, and the one-step-ahead baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.calendar import flag_label
from ledgerlens.functions.coerce import ratio
from ledgerlens.functions.statistics import error_metrics
from ledgerlens.operators.ordered import POSITION, with_position
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.schema import DATE, require_columns


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, rmse, r2."""
    require_columns(df, [actual, predicted])
    return df.agg(*[e.alias(n) for n, e in error_metrics(F.col(actual), F.col(predicted)).items()])


def error_by_flag(df: DataFrame, actual: str, predicted: str, flag_col: str = "anomaly_flag") -> DataFrame:
    """Count, mean, median and maximum of the absolute error per flag."""
    errors = df.where(F.col(flag_col).isNotNull()).select(
        flag_col, F.abs(F.col(actual) - F.col(predicted)).alias("_error"))
    medians = exact_quantiles(errors, "_error", {"median_abs_error": 0.5}, [flag_col], bounded_groups=True)
    return errors.groupBy(flag_col).agg(
        F.count("_error").alias("count"),
        F.avg("_error").alias("mean_abs_error"),
        F.max("_error").alias("max_abs_error"),
    ).join(F.broadcast(medians), flag_col, "left")


def add_errors(df: DataFrame, target_col: str = "quantity_sum",
               baseline_pred: str = "baseline_pred", anomaly_pred: str = "anomaly_pred") -> DataFrame:
    """Absolute and squared error of both models."""
    base, anom = F.col(target_col) - F.col(baseline_pred), F.col(target_col) - F.col(anomaly_pred)
    return df.withColumns({
        "baseline_abs_error": F.abs(base), "anomaly_abs_error": F.abs(anom),
        "baseline_sq_error": base * base, "anomaly_sq_error": anom * anom,
    })


def segment_report(
    df: DataFrame, target_col: str = "quantity_sum", flag_col: str = "anomaly_flag",
    baseline_pred: str = "baseline_pred", anomaly_pred: str = "anomaly_pred",
) -> DataFrame:
    """Both models per anomaly segment, and how much the second improves on the first."""
    require_columns(df, [target_col, flag_col, baseline_pred, anomaly_pred])
    errors = add_errors(df.where(F.col(flag_col).isNotNull()), target_col, baseline_pred, anomaly_pred)
    report = errors.groupBy(flag_col).agg(
        F.count(target_col).alias("count"),
        F.avg("baseline_abs_error").alias("baseline_mae"),
        F.avg("anomaly_abs_error").alias("anomaly_model_mae"),
        F.sqrt(F.avg("baseline_sq_error")).alias("baseline_rmse"),
        F.sqrt(F.avg("anomaly_sq_error")).alias("anomaly_model_rmse"),
        F.max("baseline_abs_error").alias("baseline_max_ae"),
        F.max("anomaly_abs_error").alias("anomaly_model_max_ae"),
    )
    # Both medians from one pass over (segment, model, error).
    by_model = errors.select(flag_col, F.inline(F.array(
        F.struct(F.lit("baseline").alias("_model"), F.col("baseline_abs_error").alias("_error")),
        F.struct(F.lit("anomaly_model").alias("_model"), F.col("anomaly_abs_error").alias("_error")))))
    medians = exact_quantiles(by_model, "_error", {"_median": 0.5}, [flag_col, "_model"], bounded_groups=True)
    medians = medians.groupBy(flag_col).agg(*[
        F.max(F.when(F.col("_model") == m, F.col("_median"))).alias(f"{m}_median_ae")
        for m in ("baseline", "anomaly_model")])
    report = report.join(F.broadcast(medians), flag_col, "left")
    for metric in ("mae", "rmse"):
        gain = F.col(f"baseline_{metric}") - F.col(f"anomaly_model_{metric}")
        report = report.withColumn(f"{metric}_improvement", gain).withColumn(
            f"{metric}_improvement_pct",
            ratio(F.col(f"{metric}_improvement"), F.col(f"baseline_{metric}"), 0.0) * 100)
    return report


def model_comparison_bars(report: DataFrame, metric: str = "mae", flag_col: str = "anomaly_flag") -> DataFrame:
    """One row per segment and model with the value of `metric` and its label."""
    if metric not in ("mae", "rmse"):
        raise ValueError("metric must be 'mae' or 'rmse'")
    require_columns(report, [f"baseline_{metric}", f"anomaly_model_{metric}"])
    bars = F.array(*[
        F.struct(F.lit(title).alias("model"), F.col(c).alias("value"))
        for title, c in (("Baseline", f"baseline_{metric}"), ("With Anomaly Features", f"anomaly_model_{metric}"))])
    return report.select(flag_label(F.col(flag_col)).alias("group_label"), F.inline(bars))


def critical_corrections(
    df: DataFrame, actual: str, baseline_pred: str, hybrid_pred: str, n: int = 3, tie_break: Sequence[str] = (),
) -> DataFrame:
    """The `n` rows on which the second model most reduced the absolute error of the first."""
    require_columns(df, [actual, baseline_pred, hybrid_pred])
    scored = df.withColumns({
        "baseline_abs_error": F.abs(F.col(actual) - F.col(baseline_pred)),
        "hybrid_abs_error": F.abs(F.col(actual) - F.col(hybrid_pred)),
    }).withColumn("error_reduction", F.col("baseline_abs_error") - F.col("hybrid_abs_error"))
    return scored.where(F.col("error_reduction") > 0).orderBy(
        F.desc("error_reduction"), F.desc("baseline_abs_error"), *tie_break).limit(n)


def one_step_ahead(
    series: DataFrame, value_col: str, train_until, date_col: str = DATE,
) -> DataFrame:
    """Forecast each point of a series from the point before it.

    A line through (previous, current) is fitted on points up to `train_until`; later points are
    predicted with the true previous value. Returns the later points with their prediction.
    """
    placed = with_position(series.select(date_col, value_col), [date_col], unique=True)
    earlier = placed.select((F.col(POSITION) + 1).alias(POSITION), F.col(value_col).alias("previous"))
    pairs = placed.join(earlier, POSITION, "left").withColumnRenamed(value_col, "actual")
    cut = F.lit(train_until).cast("timestamp_ntz")
    slope, intercept = pairs.where(F.col(date_col) <= cut).agg(
        F.regr_slope("actual", "previous"), F.regr_intercept("actual", "previous")).first()
    forecast = F.lit(slope).cast("double") * F.col("previous") + F.lit(intercept).cast("double")
    return pairs.where(F.col(date_col) > cut).select(
        date_col, "actual", "previous", forecast.alias("prediction"))
