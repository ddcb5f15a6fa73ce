"""Aggregate expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def signal_statistics(c: Column, prefix: str = "") -> dict[str, Column]:
    """Time-domain statistics of one signal.

    rms is the root of the mean square, peak the largest magnitude, shape factor rms over mean
    magnitude; kurtosis is the excess over a normal signal and, like skewness and the spread,
    uses population moments.
    """
    rms = F.sqrt(F.avg(c * c))
    stats = {
        "mean": F.avg(c),
        "std": F.stddev_pop(c),
        "var": F.var_pop(c),
        "rms": rms,
        "peak": F.max(F.abs(c)),
        "shape_factor": F.try_divide(rms, F.avg(F.abs(c))),
        "skewness": F.skewness(c),
        "kurtosis": F.kurtosis(c),
    }
    return {f"{prefix}{name}": expr for name, expr in stats.items()}


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """mae, rmse and r2 in one pass; r2 of a constant target is 1 for a perfect fit, else 0."""
    both = actual.isNotNull() & predicted.isNotNull()
    error = F.when(both, actual - predicted)
    target = F.when(both, actual)
    residual = F.sum(error * error)
    total = F.count(target) * F.var_pop(target)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(total > 0, 1 - residual / total).when(residual == 0, 1.0).when(residual > 0, 0.0),
    }
