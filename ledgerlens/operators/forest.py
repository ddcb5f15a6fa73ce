"""Isolation forest (Liu, Ting and Zhou, 2008) trained and scored on the cluster.

A tree needs only a few hundred rows, so training reads the data once to draw a pool whose size
depends on the parameters alone, and every tree is built from the pool in its own task. Scoring
sends just the four signal columns to Python, in Arrow batches, next to a node table whose size
is bounded by trees × rows per tree.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.functions.coerce import clip, finite, safe_numeric
from ledgerlens.operators.quantiles import column_quantiles, exact_quantiles, robust_center_scale
from ledgerlens.schema import DATE, require_columns
from ledgerlens.session import materialise

# Tasks receive these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Signal, the feature it is made from, and its bounds.
SIGNALS = (
    ("if_qty_signal", "quantity_pct_vs_mean_7d", -5, 5),
    ("if_sales_signal", "total_price_vs_mean_30d", -5, 5),
    ("if_discount_signal", "discount_mean_mean_14d", -1, 1),
    ("if_ticket_signal", "avg_ticket", 0, None),
)
FEATURES = tuple(s[0] for s in SIGNALS)
KEY = ("Product", "Region", DATE)

# The parameter grid of the full search, and the defaults it settled on.
PARAM_GRID = {
    "n_estimators": [100, 200, 300],
    "max_samples": [512, 1024, 2048],
    "contamination": [0.01, 0.03, 0.05, 0.10],
    "max_features": [0.75, 1.0],
}
BEST_PARAMS = {"n_estimators": 100, "max_samples": 512, "contamination": 0.01, "max_features": 1.0}

EXTREME_SHARE = 0.10
MIN_ROWS = 10
_EULER = 0.5772156649015329
_NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
                "size int, depth int")
_NODE_ARRAYS = {"feature": "int", "threshold": "double", "left": "int", "right": "int", "size": "int", "depth": "int"}
_TREE_SCHEMA = "setting int, fold int, tree int, " + ", ".join(f"{c} array<{t}>" for c, t in _NODE_ARRAYS.items())
_BATCH_CELLS = 1_000_000
_SCORED_ROWS = 200_000  # rows that one task of a search scores by one forest, at most about


# Signals -------------------------------------------------------------------------------------

def add_signals(df: DataFrame) -> DataFrame:
    """The four signals: source column without infinities, clipped; null stays null."""
    require_columns(df, [source for _, source, _, _ in SIGNALS])
    return df.withColumns({
        name: clip(finite(safe_numeric(df, source)), low, high) for name, source, low, high in SIGNALS})


def impute_median(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(m))) for c, m in medians.items()})


def robust_scale(df: DataFrame, medians: Mapping[str, float], scales: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(float(medians[c]))) / F.lit(float(scales[c])) for c in medians})


def scaled_name(feature: str) -> str:
    return f"{feature}_scaled"


# Trees ---------------------------------------------------------------------------------------

def average_path_length(n):
    """Mean depth of an unsuccessful search among `n` rows."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3.0)
    value = 2.0 * (np.log(many - 1.0) + _EULER) - 2.0 * (many - 1.0) / many
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def grow_tree(x: np.ndarray, max_features: float, rng: np.random.Generator) -> pd.DataFrame:
    """Random axis-parallel splits, one level of the tree at a time."""
    rows, width = x.shape
    allowed = np.zeros(width, dtype=bool)
    allowed[rng.permutation(width)[:max(1, int(max_features * width))]] = True
    limit = int(math.ceil(math.log2(max(rows, 2))))
    at = np.zeros(rows, dtype=int)          # node of each row still travelling
    alive = np.arange(rows)
    levels = [pd.DataFrame({"node": [0], "size": [rows], "depth": [0]})]
    splits = []
    next_id = 1
    for depth in range(limit):
        if not len(alive):
            break
        order = np.argsort(at, kind="stable")
        alive, at = alive[order], at[order]
        nodes, starts = np.unique(at, return_index=True)
        values = x[alive]
        low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        varies = (high > low) & allowed
        can = varies.any(axis=1)
        choice = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        pick = np.arange(len(nodes))
        lo, hi = low[pick, choice], high[pick, choice]
        cut = lo + rng.random(len(nodes)) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        left = next_id + 2 * (np.cumsum(can) - 1)
        splits.append(pd.DataFrame({
            "node": nodes[can], "feature": choice[can], "threshold": cut[can],
            "left": left[can], "right": left[can] + 1}))
        mine = np.searchsorted(nodes, at)
        go_on = can[mine]
        alive, mine = alive[go_on], mine[go_on]
        at = left[mine] + (x[alive, choice[mine]] > cut[mine])
        next_id += 2 * int(can.sum())
        children, sizes = np.unique(at, return_counts=True)
        levels.append(pd.DataFrame({"node": children, "size": sizes, "depth": depth + 1}))
    tree = pd.concat(levels).merge(pd.concat(splits), on="node", how="left") if splits else levels[0].assign(
        feature=-1, threshold=0.0, left=-1, right=-1)
    return tree.fillna({"feature": -1, "threshold": 0.0, "left": -1, "right": -1})


def pack_nodes(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """All trees as flat arrays; a leaf points to itself and carries its path length."""
    nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
    sizes = nodes.groupby("tree").size()
    roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]).astype(np.int32)
    base = np.repeat(roots, sizes.to_numpy())
    here = np.arange(len(nodes))
    leaf = (nodes["feature"] < 0).to_numpy()
    path = nodes["depth"].to_numpy() + average_path_length(nodes["size"].to_numpy())
    return {
        "roots": roots,
        "trees": sizes.index.to_numpy(),
        "feature": np.where(leaf, 0, nodes["feature"]).astype(np.int32),
        "threshold": nodes["threshold"].to_numpy(dtype=float),
        "left": np.where(leaf, here, nodes["left"] + base).astype(np.int32),
        "right": np.where(leaf, here, nodes["right"] + base).astype(np.int32),
        "path": np.where(leaf, path, 0.0),
        "levels": np.array([int(nodes["depth"].max())]),
    }


def path_lengths(x: np.ndarray, packed: Mapping[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Path length of each row in each tree, a block of rows at a time."""
    trees = len(packed["roots"])
    step = max(1, _BATCH_CELLS // trees)
    for start in range(0, len(x), step):
        block = x[start:start + step]
        row = np.arange(len(block))[:, None]
        at = np.broadcast_to(packed["roots"], (len(block), trees))
        for _ in range(int(packed["levels"][0])):
            goes_left = block[row, packed["feature"][at]] <= packed["threshold"][at]
            at = np.where(goes_left, packed["left"][at], packed["right"][at])
        yield packed["path"][at]


# Training ------------------------------------------------------------------------------------

def _row_hash(seed: int, columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def draw_pool(df: DataFrame, columns: Sequence[str], wanted: int, seed: int, rows: int | None = None) -> DataFrame:
    """About `wanted` rows (all, if there are fewer), chosen by a hash of the row.

    The choice does not depend on the partitioning. Adds the hash as `_hash`. `rows` is the number of
    rows of `df`, if it is known.
    """
    total = df.count() if rows is None else rows
    hashed = df.withColumn("_hash", _row_hash(seed, columns))
    share = (wanted + 10 * math.sqrt(wanted)) / max(total, 1)
    if share >= 1:
        return hashed
    return hashed.where(F.col("_hash") < F.lit(int(-(2 ** 63) + share * 2 ** 64)))


def _tree_plan(sizes: Mapping[int, int], trees: int, max_samples: int, seed: int) -> list[tuple]:
    """(fold, tree, stride, start, rows, pool rows): a stride coprime to the pool visits distinct rows."""
    plan = []
    for fold, pool_rows in sizes.items():
        rng = np.random.default_rng([seed, fold])
        for tree in range(trees):
            stride = int(rng.integers(1, pool_rows + 1))
            while math.gcd(stride, pool_rows) != 1:
                stride = int(rng.integers(1, pool_rows + 1))
            plan.append((fold, tree, stride, int(rng.integers(pool_rows)), min(max_samples, pool_rows), pool_rows))
    return plan


def grow_forest(
    pool: DataFrame, features: Sequence[str], trees: int, max_samples: int, max_features: float, seed: int,
) -> pd.DataFrame:
    """Node table of `trees` trees for every `_fold` of the pool, one task per tree."""
    return grow_forests(pool, features, [(trees, max_samples, max_features)], seed).drop(columns="setting")


def _draws(
    pool: DataFrame, features: Sequence[str], settings: Sequence[tuple[int, int, float]], seed: int,
) -> tuple[DataFrame, DataFrame]:
    """(setting, _fold, tree, _number, features) of the rows each tree takes, and the persisted pool they come from.

    The pool is bounded by the parameters. Its rows are numbered in hash order, a random order,
    and each tree takes evenly strided numbers, which are distinct rows.
    """
    spark = pool.sparkSession
    numbered = pool.select(
        "_fold", *features,
        (F.row_number().over(Window.partitionBy("_fold").orderBy("_hash", *features)) - 1).alias("_number"))
    numbered = numbered.persist()
    sizes = {r["_fold"]: r["rows"] for r in
             numbered.groupBy("_fold").agg(F.count(F.lit(1)).alias("rows")).orderBy("_fold").collect()}
    if not sizes:
        raise ValueError("cannot train on an empty table")
    plan = spark.createDataFrame(
        [(i, *row) for i, (trees, max_samples, _) in enumerate(settings) for row in _tree_plan(sizes, trees, max_samples, seed)],
        "setting int, _fold int, tree int, stride long, start long, rows int, pool_rows long")
    picks = plan.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(
        "setting", "_fold", "tree", ((F.col("start") + F.col("stride") * F.col("_i")) % F.col("pool_rows")).alias("_number"))
    return picks.join(numbered, ["_fold", "_number"]), numbered


def _builder(features: Sequence[str], settings: Sequence[tuple[int, int, float]], seed: int):
    """Grows the tree whose rows are in a frame of `_draws`."""
    names = list(features)
    shares = [max_features for _, _, max_features in settings]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_number", kind="stable")
        setting, fold, tree = (int(frame[c].iloc[0]) for c in ("setting", "_fold", "tree"))
        nodes = grow_tree(frame[names].to_numpy(dtype=float), shares[setting],
                          np.random.default_rng([seed, fold, tree]))
        return nodes.assign(setting=setting, fold=fold, tree=tree).astype({
            "node": "int32", "feature": "int32", "left": "int32", "right": "int32",
            "size": "int32", "depth": "int32"})

    return build


def grow_forests(
    pool: DataFrame, features: Sequence[str], settings: Sequence[tuple[int, int, float]], seed: int,
) -> pd.DataFrame:
    """Node tables of several forests, each (trees, max_samples, max_features), for every `_fold` of the pool.

    All forests grow in one job, one tree at a time; the nodes, which the caller gets whole, are bounded by
    trees x rows per tree. `grow_tree_table` leaves them on the cluster.
    """
    drawn, numbered = _draws(pool, features, settings, seed)
    nodes = drawn.groupBy("setting", "_fold", "tree").applyInPandas(
        _builder(features, settings, seed), f"setting int, fold int, {_NODE_SCHEMA}").toPandas()
    numbered.unpersist()
    return nodes


def _tree_rows(nodes: pd.DataFrame) -> pd.DataFrame:
    """One row per (setting, fold, tree), with the nodes in order as arrays."""
    nodes = nodes.sort_values(["setting", "fold", "tree", "node"], kind="stable")
    return nodes.groupby(["setting", "fold", "tree"])[list(_NODE_ARRAYS)].agg(list).reset_index()


def grow_tree_table(
    pool: DataFrame, features: Sequence[str], settings: Sequence[tuple[int, int, float]], seed: int,
) -> DataFrame:
    """The trees of `grow_forests`, one row each, written out where they grew: none passes through the driver."""
    drawn, numbered = _draws(pool, features, settings, seed)
    build = _builder(features, settings, seed)
    trees = materialise(drawn.groupBy("setting", "_fold", "tree").applyInPandas(
        lambda frame: _tree_rows(build(frame)), _TREE_SCHEMA))
    numbered.unpersist()
    return trees


@dataclass
class ForestModel:
    """Fitted imputation, scaling, trees and score offset."""

    nodes: pd.DataFrame
    medians: dict[str, float]
    scales: dict[str, float]
    max_samples: int
    contamination: float
    offset: float = 0.0
    features: tuple[str, ...] = field(default=FEATURES)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Signals of `df`, and their imputed and scaled copies `<signal>_scaled`."""
        signals = add_signals(df)
        return signals.withColumns({
            scaled_name(c): (F.coalesce(F.col(c), F.lit(self.medians[c])) - F.lit(self.medians[c]))
            / F.lit(self.scales[c]) for c in self.features})

    def normality(self, df: DataFrame) -> DataFrame:
        """`prepare` plus `_normality`: minus the anomaly score of the paper, in [−1, 0]."""
        packed = df.sparkSession.sparkContext.broadcast(pack_nodes(self.nodes))
        usual = float(average_path_length(self.max_samples))
        names = [scaled_name(c) for c in self.features]

        @F.pandas_udf("double")
        def score(frame: pd.DataFrame) -> pd.Series:
            x = frame[names].to_numpy(dtype=float)
            means = [block.mean(axis=1) for block in path_lengths(x, packed.value)]
            depth = np.concatenate(means) if means else np.empty(0)
            return pd.Series(-np.power(2.0, -depth / usual) if usual > 0 else -np.ones(len(depth)))

        return self.prepare(df).withColumn("_normality", score(F.struct(*names)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Signals, anomaly_score (negative is anomalous), anomaly_flag and anomaly_label."""
        scored = self.normality(df).withColumn("anomaly_score", F.col("_normality") - F.lit(self.offset))
        flag = (F.col("anomaly_score") < 0).cast("int")
        return scored.withColumns({
            "anomaly_flag": flag,
            "anomaly_label": F.when(flag == 1, "Anomaly").otherwise("Normal"),
        }).drop("_normality", *[scaled_name(c) for c in self.features])

    def save(self, spark: SparkSession, path: str) -> None:
        """Two Parquet tables: the nodes and one row of fitted numbers per feature."""
        spark.createDataFrame(self.nodes[["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]],
                              _NODE_SCHEMA).write.mode("errorifexists").parquet(f"{path}/nodes")
        rows = [(i, c, self.medians[c], self.scales[c], self.max_samples, self.contamination, self.offset)
                for i, c in enumerate(self.features)]
        spark.createDataFrame(
            rows, "position int, feature string, median double, scale double, max_samples int, "
                  "contamination double, offset double").coalesce(1).write.mode("errorifexists").parquet(f"{path}/fit")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        fit = spark.read.parquet(f"{path}/fit").orderBy("position").collect()
        return ForestModel(
            nodes=spark.read.parquet(f"{path}/nodes").toPandas(),
            medians={r["feature"]: r["median"] for r in fit},
            scales={r["feature"]: r["scale"] for r in fit},
            max_samples=fit[0]["max_samples"], contamination=fit[0]["contamination"], offset=fit[0]["offset"],
            features=tuple(r["feature"] for r in fit))


def _training_signals(df: DataFrame, key_cols: Sequence[str]):
    """Signals and key of the training rows, written out once, with their median and range."""
    signals = materialise(add_signals(df).select(*key_cols, *FEATURES))
    medians, scales = robust_center_scale(signals, FEATURES)
    return signals, medians, scales


def fit_forest(
    df: DataFrame, key_cols: Sequence[str] = KEY, n_estimators: int = 100, max_samples: int = 512,
    max_features: float = 1.0, contamination: float = 0.01, seed: int = 42,
) -> ForestModel:
    """Train on a feature table; `contamination` is the share of training rows to be flagged."""
    signals, medians, scales = _training_signals(df, key_cols)
    scaled = robust_scale(impute_median(signals, medians), medians, scales)
    pool = draw_pool(scaled, [*key_cols, *FEATURES], n_estimators * max_samples, seed).withColumn("_fold", F.lit(0))
    nodes = grow_forest(pool, FEATURES, n_estimators, max_samples, max_features, seed)
    rows = int(nodes.loc[nodes["node"] == 0, "size"].max())
    model = ForestModel(nodes.drop(columns="fold"), medians, scales, rows, contamination)
    sources = {name: source for name, source, _, _ in SIGNALS}
    renamed = signals.select(*[F.col(c).alias(sources[c]) for c in FEATURES])
    scores = materialise(model.normality(renamed).select("_normality"))
    model.offset = column_quantiles(scores, ["_normality"], [contamination])["_normality"][0]
    return model


# Search --------------------------------------------------------------------------------------

def _separation(cutoff: Column, score: Column, rows: Column) -> Column:
    extreme = F.avg(F.when(score <= cutoff, score))
    normal = F.avg(F.when(score > cutoff, score))
    return F.when(rows >= MIN_ROWS, F.coalesce(normal - extreme, F.lit(0.0))).otherwise(0.0)


def extreme_separation(df: DataFrame, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean score of the rows above the 10 % quantile minus the mean of those at or below it.

    0 with fewer than ten rows or with an empty side. Groups are combinations of parameters.
    """
    s = F.col(score_col)
    if not group_cols:
        cutoff = column_quantiles(df, [score_col], [EXTREME_SHARE])[score_col][0]
        return df.agg(_separation(F.lit(cutoff).cast("double"), s, F.count(s)).alias("separation"))
    groups = list(group_cols)
    cutoffs = exact_quantiles(df, score_col, {"_cutoff": EXTREME_SHARE}, groups, bounded_groups=True)
    joined = df.join(F.broadcast(cutoffs), groups)
    return joined.groupBy(*groups).agg(_separation(F.col("_cutoff"), s, F.count(s)).alias("separation"))


def search_forest(
    df: DataFrame, key_cols: Sequence[str] = KEY, grid: Mapping[str, Sequence] = PARAM_GRID,
    folds: int = 3, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Cross-validated separation of every parameter combination, and the best one.

    Contamination moves all scores by the same amount, which the criterion cancels, so its first
    value stands for all. The forest with the most trees holds the smaller ones, so tree counts
    are compared from one forest. Folds are a hash of the key.

    All forests grow in one job from one pool and score every row in one job, each forest in tasks of
    its own: the published grid has 13 million nodes, which neither the driver nor a task holds. Scores
    are columns, one per combination; quantiles and sums of all of them are aggregates over those columns.
    """
    signals, medians, scales = _training_signals(df, key_cols)
    scaled = robust_scale(impute_median(signals, medians), medians, scales)
    fold = F.pmod(_row_hash(seed + 1, key_cols), F.lit(folds)).cast("int")
    folded = scaled.withColumn("_fold", fold)
    counts = sorted(grid["n_estimators"])
    pairs = list(itertools.product(grid["max_features"], grid["max_samples"]))
    others = F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("_fold"))
    wanted = counts[-1] * max(grid["max_samples"]) * folds // max(folds - 1, 1)
    pool = draw_pool(folded, [*key_cols, *FEATURES], wanted, seed).withColumn("_fold", F.explode(others))
    trees = grow_tree_table(pool, FEATURES, [(counts[-1], rows, share) for share, rows in pairs], seed)
    scores = materialise(_fold_scores(folded, trees, counts, len(pairs)))
    separations = _fold_separations(scores, [c for c in scores.columns if c != "_fold"], folds)
    rows = [(share, samples, trees, separations[i * len(counts) + j])
            for i, (share, samples) in enumerate(pairs) for j, trees in enumerate(counts)]
    result = df.sparkSession.createDataFrame(rows, "max_features double, max_samples int, n_estimators int, separation double")
    share, samples, trees, _ = min(rows, key=lambda r: (-r[3], *r[:3]))
    return result, {"max_features": share, "max_samples": samples, "n_estimators": trees, "contamination": grid["contamination"][0]}


def _fold_separations(scores: DataFrame, columns: Sequence[str], folds: int) -> list[float]:
    """`extreme_separation` of every score column, as the mean over the folds that have rows.

    Every (column, fold) is a column of its own, so no row is made per combination.
    """
    cells = {f"{c}_{f}": F.when(F.col("_fold") == f, F.col(c)) for c in columns for f in range(folds)}
    wide = scores.select(*[v.alias(n) for n, v in cells.items()])
    cutoffs = column_quantiles(wide, list(cells), [EXTREME_SHARE])
    measures = []
    for n in cells:
        low = F.lit(cutoffs[n][0]).cast("double")
        measures += [F.count(n).alias(f"{n}_rows"), F.avg(F.when(F.col(n) <= low, F.col(n))).alias(f"{n}_low"),
                     F.avg(F.when(F.col(n) > low, F.col(n))).alias(f"{n}_high")]
    found = wide.agg(*measures).first()

    def separation(n: str) -> float:
        low, high = found[f"{n}_low"], found[f"{n}_high"]
        return high - low if found[f"{n}_rows"] >= MIN_ROWS and low is not None and high is not None else 0.0

    held = [f for f in range(folds) if found[f"{columns[0]}_{f}_rows"]]
    return [sum(separation(f"{c}_{f}") for f in held) / len(held) for c in columns]


def _pack_trees(trees: pd.DataFrame) -> dict[str, np.ndarray]:
    trees = trees.sort_values("tree", kind="stable")
    sizes = [len(v) for v in trees["feature"]]
    return pack_nodes(pd.DataFrame({
        "tree": np.repeat(trees["tree"].to_numpy(), sizes), "node": np.concatenate([np.arange(n) for n in sizes]),
        **{c: np.concatenate(trees[c].to_list()) for c in _NODE_ARRAYS}}))


def _fold_scores(folded: DataFrame, trees: DataFrame | pd.DataFrame, counts: Sequence[int], settings: int) -> DataFrame:
    """`_fold` and `s0`, `s1`, …: for each setting and tree count, the score by the first trees of the
    forest that did not see the row's fold.

    A row appears once per setting, with null for the scores of the others. A task scores a block of the
    rows of one fold by one forest, which it gets by the shuffle. `trees` is a table of `grow_tree_table`,
    or the nodes of `grow_forests`.
    """
    spark = folded.sparkSession
    if isinstance(trees, pd.DataFrame):
        trees = spark.createDataFrame(_tree_rows(trees), _TREE_SCHEMA)
    names, wanted, width = list(FEATURES), np.array(counts), len(counts)
    largest = folded.groupBy("_fold").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(largest / _SCORED_ROWS))
    group = ["_fold", "_setting", "_block"]

    def score(frame: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(frame), width))
        if len(frame) and len(forest):
            usual = float(average_path_length(max(v[0] for v in forest["size"])))
            running = np.concatenate([np.cumsum(b, axis=1)[:, wanted - 1] for b in path_lengths(
                frame[names].to_numpy(dtype=float), _pack_trees(forest))])
            out = -np.power(2.0, -running / wanted / usual) if usual > 0 else out - 1.0
        return pd.DataFrame({"_fold": frame["_fold"], "_setting": frame["_setting"], **{f"c{j}": out[:, j] for j in range(width)}})

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in folded.columns]), F.lit(blocks)).cast("int")
    rows = folded.select("_fold", *names, block.alias("_block")).withColumn("_setting", numbers(settings))
    forests = trees.withColumnsRenamed({"fold": "_fold", "setting": "_setting"}).withColumn("_block", numbers(blocks))
    parts = settings * blocks * max(1, trees.select("fold").distinct().count())
    scored = rows.repartition(parts, *group).groupBy(*group).cogroup(forests.repartition(parts, *group).groupBy(*group)).applyInPandas(
        score, "_fold int, _setting int, " + ", ".join(f"c{j} double" for j in range(width)))
    return scored.select("_fold", *[F.when(F.col("_setting") == i, F.col(f"c{j}")).alias(f"s{i * width + j}")
                                    for i in range(settings) for j in range(width)])
