"""The end-to-end runs: clean and build features, score anomalies, compare two models.

Each run writes its result to files and the next one reads those, so a lost executor never sends
a run back to the raw sales.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ledgerlens.operators.boosted import CATEGORICAL, HYBRID_NUMERIC, KEY, NUMERIC, TARGET, fit_with_params, learn_imputation, predict
from ledgerlens.operators.evaluation import segment_report
from ledgerlens.operators.features import build_features
from ledgerlens.operators.filters import by_year, split_by_year
from ledgerlens.operators.forest import BEST_PARAMS as FOREST_PARAMS, ForestModel, fit_forest
from ledgerlens.operators.joins import join_scores
from ledgerlens.operators.quality import apply_all_fixes
from ledgerlens.schema import GROUP
from ledgerlens.session import materialise, split_hot_keys
from ledgerlens.sources.tables import export_scored, scan_parquet, sink_parquet


def write_features(raw: DataFrame, path: str, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Fix the raw sales, build the features and write them by year, so that splits skip files.

    As all runs here, it lets the session split hot join keys.
    """
    split_hot_keys(raw.sparkSession)
    features = build_features(apply_all_fixes(raw), group_cols)
    sink_parquet(features, path, partition_by=["year"])
    return scan_parquet(raw.sparkSession, path)


def write_scores(
    features: DataFrame, train_years, path: str, params: Mapping[str, object] = FOREST_PARAMS,
) -> tuple[ForestModel, DataFrame]:
    """Train the forest on the training years, score every year, write the scored table."""
    train = by_year(features, train_years, year_col="year")
    model = fit_forest(train, **params)
    export_scored(model.transform(features), path)
    return model, scan_parquet(features.sparkSession, path)


@dataclass
class Comparison:
    baseline: PipelineModel
    hybrid: PipelineModel
    predictions: DataFrame
    report: DataFrame


def compare_models(
    features: DataFrame, scored: DataFrame, train_years, test_years, baseline_params: Mapping[str, object],
    hybrid_params: Mapping[str, object] | None = None, numeric: Sequence[str] = NUMERIC,
) -> Comparison:
    """Train with and without the anomaly columns, report both per anomaly segment of the test years."""
    split_hot_keys(features.sparkSession)
    extra = [c for c in HYBRID_NUMERIC if c not in NUMERIC]
    # Written once: the join feeds the imputation, both fits and the predictions.
    joined = materialise(join_scores(features, scored))
    train, test = split_by_year(joined, train_years, test_years, year_col="year")
    fill = learn_imputation(train, [*numeric, *extra], CATEGORICAL)
    baseline = fit_with_params(train, baseline_params, numeric, fill=fill)
    hybrid = fit_with_params(train, hybrid_params or baseline_params, [*numeric, *extra], fill=fill)
    # Both models see the same rows; tables from elsewhere are brought together by `align_models`.
    both = predict(hybrid, predict(baseline, test, "baseline_pred"), "anomaly_pred")
    aligned = materialise(both.select(*KEY, TARGET, "anomaly_flag", "baseline_pred", "anomaly_pred"))
    if aligned.isEmpty():
        raise ValueError("no row in the test years")
    return Comparison(baseline, hybrid, aligned, segment_report(aligned))
