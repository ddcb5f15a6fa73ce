"""Times the headline queries and prints one JSON line.

Each query runs three times and the best time counts, so that start-up and compilation do not.
Model fits run once, after the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.operators import attribution, boosted, features, forest, quality  # noqa: E402
from ledgerlens.operators.filters import by_year  # noqa: E402
from ledgerlens.session import local_session, materialise  # noqa: E402
from workload import models, registry, tables, views  # noqa: E402,F401
import workload.quality  # noqa: E402,F401

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

REPEATED = (
    "dq_report", "apply_all_fixes", "neighbor_mean_fill", "daily_metrics_full", "build_all_features",
    "join_features_to_sales", "join_align_models", "outlier_iqr_global", "outlier_iqr_rolling",
    "period_distribution", "period_density", "segment_report", "sensor_run_features",
)


def timed(make) -> float:
    start = time.perf_counter()
    frame = make()
    if frame is not None:
        frame.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, "bench", partitions=max(int(CPUS), 1))
    times = {"join_and_write_sales": timed(lambda: materialise(views.joined_sales(spark, SF_DIR)))}
    # From the raw tables to the finished features, nothing written beforehand.
    raw = lambda: features.build_features(views.joined_sales(spark, SF_DIR))
    times["raw_tables_to_features"] = min(timed(raw) for _ in range(3))
    views.sales(spark, SF_DIR)
    for name in REPEATED:
        times[name] = min(timed(lambda: registry.QUERIES[name](spark, SF_DIR)) for _ in range(3))
    wide = lambda: features.build_wide_features(views.sales(spark, SF_DIR))
    times["data_features"] = min(timed(wide) for _ in range(3))

    start = time.perf_counter()
    table = models.feature_table(spark, SF_DIR)
    times["feature_table"] = round(time.perf_counter() - start, 3)
    train, test = by_year(table, models.TRAIN_YEARS), by_year(table, models.TEST_YEARS)
    made = {}

    def fit(name, make):
        start = time.perf_counter()
        made[name] = make()
        times[name] = round(time.perf_counter() - start, 3)

    fit("isolation_forest_fit", lambda: forest.fit_forest(train, **models.FOREST))
    times["isolation_forest_score"] = timed(lambda: made["isolation_forest_fit"].transform(table))
    fit("fit_with_best_params", lambda: boosted.fit_with_params(train, models.TREES))
    times["predict_model"] = timed(lambda: boosted.predict(made["fit_with_best_params"], test))
    fit("explain_boosted", lambda: attribution.explain_boosted(made["fit_with_best_params"], table))
    explainer = made["explain_boosted"]
    times["shap_importance"] = timed(lambda: attribution.explained_importance(explainer, test))
    times["shap_values"] = timed(lambda: attribution.shap_matrix(explainer, test, models.KEYS))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
