"""Exact path-dependent tree attributions (Lundberg et al., 2018) as tables.

Each leaf is a product of intervals, one per feature on its path. A feature inside its interval
counts 1, one that is left out counts the share of training rows that would pass, so the
attribution of a leaf depends only on which of its few features a row satisfies. Those cases are
tabulated per leaf and looked up for whole batches of rows. Paths of many features are cut into
slices with a table each, and the sums by number of known features are multiplied like
polynomials, so tables grow with the leaves and not with two to the depth.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.operators.boosted import feature_names
from ledgerlens.operators.evaluation import critical_corrections
from ledgerlens.operators.anomalies import top_anomalies
from ledgerlens.operators.forest import ForestModel, average_path_length, scaled_name
from ledgerlens.session import fresh_path, materialise

# Tasks receive these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUES = "_values"
SHAP = "_shap"
_WHOLE = 6  # features of a path tabulated together: 3 KB a leaf
_SLICE = 3  # features of a slice of a longer path
_BATCH_CELLS = 2_000_000


# Trees as leaves -----------------------------------------------------------------------------

def _weights(m: int) -> np.ndarray:
    """Weight of a set of k of the other features, for each k, on a path of m features."""
    return np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials, coefficients along the last axis."""
    out = np.zeros((*np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), a.shape[-1] + b.shape[-1] - 1))
    for k in range(b.shape[-1]):
        out[..., k:k + a.shape[-1]] += a * b[..., k:k + 1]
    return out


def _by_size(present: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sums over the sets of k known features (last axis: k) of the product over all features."""
    out = np.ones((*present.shape[:-1], 1))
    for j in range(present.shape[-1]):
        out = _times(out, np.stack([share[..., j], present[..., j]], axis=-1))
    return out


def _gains(present: np.ndarray, share: np.ndarray) -> Iterator[np.ndarray]:
    """For each feature what knowing it changes, by number of known others (last axis)."""
    for i in range(present.shape[-1]):
        others = _by_size(np.delete(present, i, -1), np.delete(share, i, -1))
        yield (present[..., i] - share[..., i])[..., None] * others


def shapley(present: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Attribution of a leaf of value 1 over its features, along the last axis.

    `present` is 1 where the row satisfies the leaf's interval of a feature, `share` the fraction
    of rows that passes when the feature is unknown.
    """
    present, share = np.broadcast_arrays(present, share)
    weight = _weights(present.shape[-1])
    return np.stack([gain @ weight for gain in _gains(present, share)], axis=-1)


def _slices(share: np.ndarray, value: np.ndarray) -> list[dict]:
    """Tables of leaves × cases for each slice of the path.

    The only slice of a short path holds the attributions; slices of a longer one hold the gains
    within the slice, and the sums by size that the other slices are multiplied with.
    """
    m = share.shape[-1]
    width = m if m <= _WHOLE else _SLICE
    found = []
    for first in range(0, m, width):
        part = share[:, None, first:first + width]
        w = part.shape[-1]
        cases = ((np.arange(1 << w)[:, None] >> np.arange(w)) & 1).astype(float)
        present, part = np.broadcast_arrays(cases, part)
        tables = {"first": first, "bit": 1 << np.arange(w)}
        if w == m:
            tables["shap"] = shapley(present, part) * value[:, None, None]
        else:
            tables["gains"] = np.stack(list(_gains(present, part)), axis=-2) * value[:, None, None, None]
            tables["by_size"] = _by_size(present, part)
        found.append(tables)
    return found


def _looked_up(slices: Sequence[Mapping], present: np.ndarray) -> np.ndarray:
    """Attributions, rows × leaves × features of the path."""
    leaves, m = np.arange(present.shape[1]), present.shape[2]
    case = [present[..., s["first"]:s["first"] + len(s["bit"])] @ s["bit"] for s in slices]
    if len(slices) == 1:
        return slices[0]["shap"][leaves, case[0]]
    weight = _weights(m)
    by_size = [s["by_size"][leaves, c] for s, c in zip(slices, case)]
    out = []
    for n, (s, c) in enumerate(zip(slices, case)):
        outside = np.ones((1, 1, 1))
        for other, sums in enumerate(by_size):
            if other != n:
                outside = _times(outside, sums)
        held = [outside @ weight[k:k + outside.shape[-1]] for k in range(len(s["bit"]))]
        out.append((s["gains"][leaves, c] * np.stack(held, axis=-1)[..., None, :]).sum(axis=-1))
    return np.concatenate(out, axis=-1)


def _leaves(nodes: pd.DataFrame) -> list[tuple]:
    """(value, features, lower, upper, share) of every leaf of every tree.

    `nodes` has tree, node, feature (−1 for a leaf), threshold, left, right, value, cover; rows
    with x ≤ threshold go left.
    """
    found = []
    for _, tree in nodes.groupby("tree", sort=True):
        rows = {r.node: r for r in tree.itertuples(index=False)}
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            r = rows[node]
            if r.feature < 0:
                names = sorted(path)
                found.append((r.value, names, *[[path[f][k] for f in names] for k in range(3)]))
                continue
            low, high, share = path.get(r.feature, (-math.inf, math.inf, 1.0))
            for child, lo, hi in ((r.left, low, min(high, r.threshold)), (r.right, max(low, r.threshold), high)):
                passed = share * (rows[child].cover / r.cover if r.cover else 0.0)
                stack.append((child, {**path, r.feature: (lo, hi, passed)}))
    return found


@dataclass
class Ensemble:
    """Leaves of a tree ensemble grouped by number of features, and the expected output."""

    groups: list[dict]
    base: float
    width: int

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, width: int) -> "Ensemble":
        by_size: dict[int, list] = {}
        base = 0.0
        for leaf in _leaves(nodes):
            base += leaf[0] * math.prod(leaf[4])
            by_size.setdefault(len(leaf[1]), []).append(leaf)
        groups = []
        for m, leaves in sorted(by_size.items()):
            if m == 0:
                continue
            value = np.array([x[0] for x in leaves])
            feature = np.array([x[1] for x in leaves], dtype=int)
            order = np.argsort(feature, axis=None, kind="stable")
            columns, starts = np.unique(feature.ravel()[order], return_index=True)
            groups.append({
                "m": m, "value": value, "feature": feature, "order": order, "columns": columns, "starts": starts,
                "lower": np.array([x[2] for x in leaves]), "upper": np.array([x[3] for x in leaves]),
                "slices": _slices(np.array([x[4] for x in leaves]), value),
            })
        return Ensemble(groups, base, width)

    def explain(self, x: np.ndarray) -> np.ndarray:
        """Attributions, rows × features."""
        return explain_rows(self.groups, self.width, x)


def explain_rows(groups: Sequence[Mapping], width: int, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), width))
    for g in groups:
        step = max(1, _BATCH_CELLS // (len(g["value"]) * g["m"] * len(g["slices"])))
        for start in range(0, len(x), step):
            cells = x[start:start + step][:, g["feature"]]
            present = (cells > g["lower"]) & (cells <= g["upper"])
            part = _looked_up(g["slices"], present)
            flat = part.reshape(len(cells), -1)[:, g["order"]]
            out[start:start + step, g["columns"]] += np.add.reduceat(flat, g["starts"], axis=1)
    return out


def forest_nodes(model: ForestModel) -> pd.DataFrame:
    """Nodes whose ensemble output is the mean path length (a short path is anomalous)."""
    nodes = model.nodes.copy()
    trees = nodes["tree"].nunique()
    path = nodes["depth"] + average_path_length(nodes["size"])
    return nodes.assign(value=path / trees, cover=nodes["size"])


def boosted_nodes(model: PipelineModel, df: DataFrame) -> pd.DataFrame:
    """Nodes of the boosted trees, read from the files of the saved model.

    Their number is bounded by the training parameters. A two-valued split becomes a threshold.
    """
    spark = df.sparkSession
    regressor = model.stages[-1]
    path = fresh_path(spark, "boosted-trees")
    regressor.save(path)
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("value"), F.col("nodeData.rawCount").cast("double").alias("cover"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut"),
        F.col("nodeData.split.numCategories").alias("categories"),
    ).toPandas()
    weights = dict(enumerate(regressor.treeWeights))
    leaf = saved["left"] < 0
    two_valued = ~leaf & (saved["categories"] >= 0)
    if (saved.loc[two_valued, "categories"] > 2).any():
        raise ValueError("only continuous and two-valued splits can be explained")
    threshold = [0.5 if c else (cut[0] if len(cut) else 0.0) for c, cut in zip(two_valued, saved["cut"])]
    swap = two_valued & pd.Series([len(cut) == 1 and cut[0] == 1.0 for cut in saved["cut"]])
    return pd.DataFrame({
        "tree": saved["tree"], "node": saved["node"], "feature": saved["feature"].where(~leaf, -1),
        "threshold": threshold,
        "left": saved["left"].where(~swap, saved["right"]), "right": saved["right"].where(~swap, saved["left"]),
        "value": saved["value"] * saved["tree"].map(weights), "cover": saved["cover"],
    })


# Explained tables ----------------------------------------------------------------------------

@dataclass
class Explainer:
    """Adds `_values` and `_shap`, two arrays in the order of `names`, to each row."""

    ensemble: Ensemble
    names: list[str]
    raw_names: list[str]
    prepare: object
    inputs: Column

    @property
    def base(self) -> float:
        return self.ensemble.base

    def arrays(self, df: DataFrame) -> DataFrame:
        # Plain arrays, whose size the training parameters bound.
        shared = df.sparkSession.sparkContext.broadcast(self.ensemble.groups)
        width = self.ensemble.width

        @F.pandas_udf("array<double>")
        def explain(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            return pd.Series(list(explain_rows(shared.value, width, np.stack(values.to_numpy()))))

        prepared = self.prepare(df).select(*[F.col(c) for c in df.columns], self.inputs.alias(VALUES))
        return prepared.withColumn(SHAP, explain(VALUES))

    def entries(self) -> Column:
        """One struct (feature, raw_feature, value, shap) per feature."""
        names = F.array(*[F.lit(n) for n in self.names])
        raw = F.array(*[F.lit(n) for n in self.raw_names])
        zipped = F.arrays_zip(names.alias("feature"), raw.alias("raw_feature"),
                              F.col(VALUES).alias("value"), F.col(SHAP).alias("shap"))
        return F.transform(zipped, lambda e: F.struct(
            e["feature"].alias("feature"), e["raw_feature"].alias("raw_feature"),
            e["value"].alias("value"), e["shap"].alias("shap")))

    def long(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, feature, raw_feature, value, shap), one row per row and feature."""
        return self.arrays(df).select(*keys, F.inline(self.entries()))


def explain_forest(model: ForestModel) -> Explainer:
    ensemble = Ensemble.from_nodes(forest_nodes(model), len(model.features))
    inputs = F.array(*[F.col(scaled_name(c)) for c in model.features])
    names = list(model.features)

    def prepare(df: DataFrame) -> DataFrame:
        return model.prepare(df)

    return Explainer(ensemble, names, names, prepare, inputs)


def explain_boosted(model: PipelineModel, df: DataFrame) -> Explainer:
    names, raw = feature_names(model)
    ensemble = Ensemble.from_nodes(boosted_nodes(model, df), len(names))
    preprocessor = PipelineModel(model.stages[:-1])
    return Explainer(ensemble, names, raw, preprocessor.transform, vector_to_array("features"))


def resolve_feature(explainer: Explainer, name: str) -> str:
    """A transformed name given in full, by its ending, or by a part that only one name has."""
    for matches in (
        [n for n in explainer.names if n == name],
        [n for n in explainer.names if n.endswith(f"__{name}")],
        [n for n in explainer.names if name in n],
    ):
        if len(matches) == 1:
            return matches[0]
    raise ValueError(f"feature {name!r} not found among {explainer.names[:10]}")


def shap_matrix(explainer: Explainer, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per row: base value, values and attributions, and their sum (the model output)."""
    total = F.aggregate(SHAP, F.lit(explainer.base), lambda acc, x: acc + x)
    return explainer.arrays(df).select(
        *keys, F.lit(explainer.base).alias("base_value"), F.col(VALUES).alias("values"),
        F.col(SHAP).alias("shap"), total.alias("output"))


def shap_importance(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature")


def explained_importance(explainer: Explainer, df: DataFrame) -> DataFrame:
    """`shap_importance` straight from the arrays: one aggregate per feature, then one row is turned."""
    means = [F.avg(F.abs(F.col(SHAP)[i])).alias(f"m{i}") for i in range(len(explainer.names))]
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap")) for i, n in enumerate(explainer.names)]
    return explainer.arrays(df).agg(*means).select(F.inline(F.array(*entries))).orderBy(F.desc("mean_abs_shap"), "feature")


def shap_summary(long: DataFrame) -> DataFrame:
    """Rows behind a summary plot: attribution and the value scaled to 0…1 within its feature.

    `long` is read twice and is written out first, so that rows are explained once.
    """
    long = materialise(long)
    # One row per feature of the model.
    ranges = F.broadcast(long.groupBy("feature").agg(F.min("value").alias("_low"), F.max("value").alias("_high")))
    spread = F.col("_high") - F.col("_low")
    scaled = F.when(spread > 0, (F.col("value") - F.col("_low")) / spread).otherwise(0.5)
    return long.join(ranges, "feature").withColumn("scaled_value", scaled).drop("_low", "_high")


def shap_dependence(explainer: Explainer, df: DataFrame, feature: str, keys: Sequence[str]) -> DataFrame:
    """Value and attribution of one feature per row."""
    i = explainer.names.index(resolve_feature(explainer, feature))
    return explainer.arrays(df).select(
        *keys, F.lit(explainer.names[i]).alias("feature"),
        F.col(VALUES)[i].alias("value"), F.col(SHAP)[i].alias("shap"))


def ranked_entries(explainer: Explainer) -> Column:
    """The entries of a row by decreasing absolute attribution, equal ones by name.

    Sorted inside the row, so ranking needs no shuffle.
    """
    keyed = F.transform(explainer.entries(), lambda e: F.struct(
        (-F.abs(e["shap"])).alias("_by"), e["feature"].alias("feature"), e["raw_feature"].alias("raw_feature"),
        e["value"].alias("value"), e["shap"].alias("shap")))
    return F.array_sort(keyed)


def rank_drivers(explainer: Explainer, df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, rank, feature, raw_feature, value, shap) for the `k` strongest features of each row."""
    top = F.slice(ranked_entries(explainer), 1, k)
    ranked = explainer.arrays(df).select(*keys, F.posexplode(top).alias("_i", "_e"))
    return ranked.select(*keys, (F.col("_i") + 1).alias("rank"), "_e.feature", "_e.raw_feature", "_e.value", "_e.shap")


def explain_anomaly_drivers(
    explainer: Explainer, scored: DataFrame, top_n: int = 10, top_features: int = 2, product=None, region=None,
) -> DataFrame:
    """The worst anomalies, each with its strongest signals in columns top_driver_1, …"""
    worst = top_anomalies(scored, top_n, product, region, columns=scored.columns)
    meta = [c for c in ("Order_Date", "Product", "Region", "quantity_sum", "total_price_sum", "avg_ticket",
                        "anomaly_label", "anomaly_score") if c in scored.columns]
    ranked = explainer.arrays(worst).withColumn("_top", ranked_entries(explainer))
    drivers = []
    for r in range(1, min(top_features, len(explainer.names)) + 1):
        e = F.element_at("_top", r)
        drivers += [e["feature"].alias(f"top_driver_{r}"), e["value"].alias(f"top_driver_{r}_value"),
                    e["shap"].alias(f"top_driver_{r}_shap")]
    return ranked.select(*meta, *drivers)


def force_data(explainer: Explainer, df: DataFrame, key: Mapping[str, object]) -> DataFrame:
    """Base value and every contribution of the one row named by `key`."""
    row = df
    for column, value in key.items():
        row = row.where(F.col(column) == F.lit(value))
    return explainer.long(row, list(key)).withColumn("base_value", F.lit(explainer.base))


def _critical(explainer, df, keys, actual, baseline_pred, hybrid_pred, n):
    cases = critical_corrections(df, actual, baseline_pred, hybrid_pred, n, keys)
    facts = {"actual": actual, "baseline_prediction": baseline_pred, "hybrid_prediction": hybrid_pred,
             "error_reduction": "error_reduction"}
    # The cases are `n` rows; the ranked entries stay inside each of them.
    return explainer.arrays(cases).withColumn("_ranked", ranked_entries(explainer)), [
        F.col(c).alias(name) for name, c in facts.items()]


def force_data_critical(
    explainer: Explainer, df: DataFrame, keys: Sequence[str], actual: str, baseline_pred: str, hybrid_pred: str,
    top_n: int = 3, max_display: int = 5,
) -> DataFrame:
    """The strongest contributions of the most corrected rows."""
    cases, facts = _critical(explainer, df, keys, actual, baseline_pred, hybrid_pred, top_n)
    top = cases.select(*keys, *facts, F.posexplode(F.slice("_ranked", 1, max_display)).alias("_i", "_e"))
    names = ["actual", "baseline_prediction", "hybrid_prediction", "error_reduction"]
    return top.select(*keys, *names, F.lit(explainer.base).alias("base_value"), (F.col("_i") + 1).alias("rank"),
                      "_e.feature", "_e.value", "_e.shap")


def waterfall_critical(
    explainer: Explainer, df: DataFrame, keys: Sequence[str], actual: str, baseline_pred: str, hybrid_pred: str,
    top_n: int = 3, max_display: int = 5,
) -> DataFrame:
    """Steps from the base value to the prediction for the most corrected rows.

    All but the strongest `max_display` − 1 features form one step, "other", which comes first;
    the rest follow from weakest to strongest.
    """
    cases, facts = _critical(explainer, df, keys, actual, baseline_pred, hybrid_pred, top_n)
    shown = max_display if len(explainer.names) <= max_display else max_display - 1
    steps = cases.select(*keys, *facts, F.posexplode("_ranked").alias("_i", "_e"))
    bucket = F.least(F.col("_i"), F.lit(shown))
    other = F.col("_step") >= shown
    names = ["actual", "baseline_prediction", "hybrid_prediction", "error_reduction"]
    merged = steps.groupBy(*keys, *names, bucket.alias("_step")).agg(
        F.sum("_e.shap").alias("shap"), F.any_value("_e.feature").alias("feature"),
        F.any_value("_e.value").alias("value"))
    # At most `max_display` rows per case.
    w = Window.partitionBy(*keys).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(explainer.base) + F.sum("shap").over(w)
    return merged.withColumn("end_value", end).select(
        *keys, *names, (F.col("_step") + 1).alias("rank"),
        F.when(other, "other").otherwise(F.col("feature")).alias("feature"),
        F.when(~other, F.col("value")).alias("value"),
        "shap", (F.col("end_value") - F.col("shap")).alias("start_value"), "end_value")
