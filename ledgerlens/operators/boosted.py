"""Gradient-boosted regression of daily quantity with Spark ML."""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.features import ROLLING_COLUMNS
from ledgerlens.operators.quantiles import column_quantiles
from ledgerlens.schema import DATE, require_columns
from ledgerlens.session import materialise

TARGET = "quantity_sum"
KEY = ("Product", "Region", DATE)
ROWS_PER_PARTITION = 50_000
# Fits of a search run side by side and share the cores, so each is cut into fewer tasks.
SEARCH_ROWS_PER_PARTITION = 250_000
SEARCH_TASKS_PER_CORE = 2
CHECKPOINT_TREES = 20

# Model inputs, and the default search grid.
CATEGORICAL = ("Product", "Region")
NUMERIC = (
    "total_price_sum", "unit_price_mean", "discount_mean", "order_count", "customer_count", "avg_ticket",
    "day_of_week", "month", "is_weekend",
    "quantity_sum_mean_7d", "quantity_sum_std_7d", "quantity_sum_sum_7d", "total_price_sum_mean_7d",
    "total_price_sum_std_7d", "total_price_sum_mean_30d", "unit_price_mean_mean_7d", "discount_mean_mean_14d",
    "quantity_vs_mean_7d", "total_price_vs_mean_30d", "quantity_pct_vs_mean_7d",
    "history_less_than_7d", "history_less_than_30d",
)
HYBRID_NUMERIC = NUMERIC + ("anomaly_score", "anomaly_flag")
PARAM_GRID = {
    "n_estimators": [150, 200],
    "learning_rate": [0.05, 0.08],
    "num_leaves": [31, 63],
    "max_depth": [-1, 7, 12],
    "subsample": [0.8],
    "colsample_bytree": [0.8],
    "min_child_samples": [20, 50],
}
BEST_PARAMS = {
    "n_estimators": 200, "learning_rate": 0.08, "num_leaves": 63, "max_depth": -1,
    "subsample": 0.8, "colsample_bytree": 0.8, "min_child_samples": 20,
}

# Inputs known before the day is over; the full list also holds same-day totals, and the target is
# the sum of two of its members.
PAST_ONLY = tuple(c for c in NUMERIC if c in ROLLING_COLUMNS) + (
    "day_of_week", "month", "is_weekend", "history_less_than_7d", "history_less_than_30d")


def select_features(
    df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL,
    target: str | None = TARGET, keys: Sequence[str] = (),
) -> DataFrame:
    wanted = list(dict.fromkeys([*keys, *numeric, *categorical, *([target] if target else [])]))
    require_columns(df, wanted)
    return df.select(*wanted)


def most_frequent(df: DataFrame, column: str) -> str | None:
    """Most frequent value, the smallest one on a tie."""
    row = (df.where(F.col(column).isNotNull()).groupBy(column).count()
           .orderBy(F.desc("count"), column).first())
    return None if row is None else row[column]


def learn_imputation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Median of each numeric and most frequent value of each categorical column."""
    medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in column_quantiles(df, numeric, [0.5]).items()}
    return {**medians, **{c: most_frequent(df, c) or "" for c in categorical}}


def learn_fold_imputation(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold_col: str, folds: Sequence[int],
) -> dict[int, dict[str, object]]:
    """What `learn_imputation` finds in the rows outside each fold, for all folds in the same jobs."""
    cells = {(f, c): f"{f}_{i}" for f in folds for i, c in enumerate(numeric)}
    wide = df.select(*[F.when(F.col(fold_col) != f, F.col(c).cast("double")).alias(n) for (f, c), n in cells.items()])
    medians = column_quantiles(wide, list(cells.values()), [0.5]) if cells else {}
    found = {f: {c: medians[cells[f, c]][0] or 0.0 for c in numeric} for f in folds}
    for c in categorical:
        outside = [F.count(F.when(F.col(fold_col) != f, 1)).alias(f"n{f}") for f in folds]
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(*outside)
        best = counts.agg(*[F.min(F.when(F.col(f"n{f}") > 0, F.struct(-F.col(f"n{f}"), "value"))).alias(f"f{f}") for f in folds]).first()
        for f in folds:
            found[f][c] = best[f"f{f}"]["value"] if best[f"f{f}"] else ""
    return found


def _quoted(text: object) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessor(
    df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL,
    fill: Mapping[str, object] | None = None,
) -> PipelineModel:
    """Imputation, one-hot block without unknown values, and the assembled `features` vector.

    `fill` is what `learn_imputation` found before, for models that share their rows.
    """
    require_columns(df, [*numeric, *categorical])
    fill = learn_imputation(df, numeric, categorical) if fill is None else fill
    filled = [f"coalesce(cast(`{c}` AS DOUBLE), {fill[c]!r}D) AS `numeric__{c}`" for c in numeric]
    filled += [f"coalesce(cast(`{c}` AS STRING), {_quoted(fill[c])}) AS `filled__{c}`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    inputs = [f"numeric__{c}" for c in numeric]
    if categorical:
        stages.append(StringIndexer(
            inputCols=[f"filled__{c}" for c in categorical], outputCols=[f"index__{c}" for c in categorical],
            handleInvalid="keep", stringOrderType="alphabetAsc").fit(stages[0].transform(df)))
        indexed = stages[1].transform(stages[0].transform(df))
        stages.append(OneHotEncoder(
            inputCols=[f"index__{c}" for c in categorical], outputCols=[f"categorical__{c}" for c in categorical],
            dropLast=True).fit(indexed))
        inputs += [f"categorical__{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages)


def feature_names(model: PipelineModel) -> tuple[list[str], list[str]]:
    """Names of the vector's entries as (transformed, raw)."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    labels = {}
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            labels = {c.removeprefix("filled__"): found for c, found in zip(stage.getInputCols(), stage.labelsArray)}
    transformed, raw = [], []
    for column in assembler.getInputCols():
        kind, name = column.split("__", 1)
        if kind == "numeric":
            transformed.append(column)
            raw.append(name)
        else:
            transformed += [f"{column}_{value}" for value in labels[name]]
            raw += [name] * len(labels[name])
    return transformed, raw


def tree_params(params: Mapping[str, object]) -> dict[str, object]:
    """Settings of the Spark regressor for one grid entry.

    Spark grows trees by depth, so a number of leaves becomes the depth that can hold it, and
    column sampling is per node. Row sampling has no effect without a bagging interval, which
    the grid never sets, so it is left at 1.
    """
    depth = max(1, round(math.log2(int(params.get("num_leaves", 31)) + 1)))
    limit = int(params.get("max_depth", -1))
    return {
        "maxIter": int(params.get("n_estimators", 100)),
        "stepSize": float(params.get("learning_rate", 0.1)),
        "maxDepth": depth if limit <= 0 else min(depth, limit),
        "minInstancesPerNode": int(params.get("min_child_samples", 20)),
        "featureSubsetStrategy": str(params["colsample_bytree"]) if "colsample_bytree" in params else "all",
    }


def _regressor(target: str, seed: int) -> GBTRegressor:
    # One pass may collect the statistics of many nodes. A row finds its node again in each pass: a few
    # comparisons are cheaper than a table of node numbers written anew for every level.
    return GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", seed=seed,
                        cacheNodeIds=False, maxMemoryInMB=1024, checkpointInterval=CHECKPOINT_TREES)


def _vectors(ready: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The training rows in memory, in few partitions: each tree is several short jobs over all of them."""
    ready = ready.persist()
    cores = ready.sparkSession.sparkContext.defaultParallelism
    wanted = min(max(1, math.ceil(ready.count() / rows_per_partition)), 4 * cores)
    if wanted >= ready.rdd.getNumPartitions():
        return ready
    packed = ready.repartition(wanted).persist()
    packed.count()
    ready.unpersist()
    return packed


def fit_with_params(
    df: DataFrame, params: Mapping[str, object] = BEST_PARAMS, numeric: Sequence[str] = NUMERIC,
    categorical: Sequence[str] = CATEGORICAL, target: str = TARGET, seed: int = 3,
    fill: Mapping[str, object] | None = None,
) -> PipelineModel:
    """Train once with known parameters."""
    require_columns(df, [target])
    preprocessor = fit_preprocessor(df, numeric, categorical, fill)
    ready = _vectors(preprocessor.transform(df).select("features", F.col(target).cast("double").alias(target)))
    model = _regressor(target, seed).setParams(**tree_params(params)).fit(ready)
    ready.unpersist()
    return PipelineModel([*preprocessor.stages, model])


def fit_with_search(
    df: DataFrame, grid: Mapping[str, Sequence] = PARAM_GRID, numeric: Sequence[str] = NUMERIC,
    categorical: Sequence[str] = CATEGORICAL, target: str = TARGET, folds: int = 3, seed: int = 3,
    key_cols: Sequence[str] = KEY, parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame, dict]:
    """Cross-validated grid search on RMSE: best model, one row per combination, best parameters.

    Folds are a hash of the key, so they do not depend on the partitioning. Each fold is imputed with
    what the other folds hold. Combinations that come to the same tree settings are fitted once, and
    fewer trees are the first ones of more trees, whose errors one pass gives for every number of trees;
    so the full grid of 48 is 8 fits a fold. A fit is many short jobs, so fits of all folds run side by
    side: `parallelism` at least, and on few rows as many as keep the cores at work.
    """
    require_columns(df, [target, *key_cols])
    names = list(grid)
    combinations = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    settings = [tree_params(c) for c in combinations]
    kinds = [tuple((k, v) for k, v in sorted(s.items()) if k != "maxIter") for s in settings]
    most = {kind: max(s["maxIter"] for s, k in zip(settings, kinds) if k == kind) for kind in kinds}
    fold = F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(folds)).cast("int")
    folded = materialise(select_features(df, numeric, categorical, target, key_cols).withColumn("_fold", fold))
    held = [r["_fold"] for r in folded.groupBy("_fold").count().orderBy("_fold").collect()]
    if len(held) < 2:
        raise ValueError("the rows fall into fewer than two folds")
    fills = learn_fold_imputation(folded, numeric, categorical, "_fold", held)
    regressor = _regressor(target, seed)
    ready = {}
    for f in held:
        outside = folded.where(F.col("_fold") != f)
        ready[f] = _vectors(fit_preprocessor(outside, numeric, categorical, fills[f]).transform(folded).select(
            "features", F.col(target).cast("double").alias(target), "_fold"), SEARCH_ROWS_PER_PARTITION)

    def errors(fit: tuple[int, tuple]) -> list[float]:
        f, kind = fit
        train, valid = ready[f].where(F.col("_fold") != f), ready[f].where(F.col("_fold") == f)
        model = regressor.fit(train, {regressor.getParam(k): v for k, v in (*kind, ("maxIter", most[kind]))})
        return model.evaluateEachIteration(valid, "squared")

    fits = list(itertools.product(held, most))
    tasks = SEARCH_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    at_once = max(parallelism, math.ceil(tasks / ready[held[0]].rdd.getNumPartitions()))
    with ThreadPoolExecutor(min(at_once, len(fits))) as pool:
        squares = dict(zip(fits, pool.map(errors, fits)))
    for rows in ready.values():
        rows.unpersist()
    rmse = [sum(math.sqrt(squares[f, kind][s["maxIter"] - 1]) for f in held) / len(held) for s, kind in zip(settings, kinds)]
    best = min(range(len(rmse)), key=rmse.__getitem__)
    rows = [(i, *[float(c[n]) for n in names], m, i == best) for i, (c, m) in enumerate(zip(combinations, rmse))]
    schema = "combination int, " + ", ".join(f"{n} double" for n in names) + ", rmse double, best boolean"
    table = df.sparkSession.createDataFrame(rows, schema)
    return fit_with_params(folded, combinations[best], numeric, categorical, target, seed), table, combinations[best]


def predict(model: PipelineModel, df: DataFrame, output: str = "prediction") -> DataFrame:
    """`df` with one more column."""
    predicted = model.transform(df)
    return predicted.select(*[F.col(c) for c in df.columns], F.col("prediction").alias(output))
