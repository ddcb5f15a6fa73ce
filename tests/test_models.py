import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerlens.operators import attribution, boosted, forest
from ledgerlens.operators.filters import by_year
from ledgerlens.plans import sales as plans
from tests.test_features import COLUMNS, sale


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 3000
    frame = pd.DataFrame({
        "Product": rng.choice(["p1", "p2", "p3"], n), "Region": rng.choice(["n", "s"], n),
        "Order_Date": pd.to_datetime("2021-01-01") + pd.to_timedelta(np.arange(n) % 1000, "D"),
        **{c: rng.normal(size=n) for c in boosted.NUMERIC}})
    frame["quantity_sum"] = 5 * frame["quantity_sum_mean_7d"] + frame["total_price_sum"] * (frame["Product"] == "p2")
    frame.loc[7, ["quantity_pct_vs_mean_7d", "total_price_vs_mean_30d", "avg_ticket"]] = [4.9, 4.9, 60.0]
    frame.loc[::40, "avg_ticket"] = np.nan
    frame["k"] = np.arange(n)
    return spark.createDataFrame(frame).withColumn("Order_Date", F.col("Order_Date").cast("date"))


KEYS = ["k", "Product", "Region", "Order_Date"]


@pytest.fixture(scope="module")
def fitted(table):
    return forest.fit_forest(table, KEYS, n_estimators=40, max_samples=128, contamination=0.05)


def test_path_length_of_small_counts():
    assert forest.average_path_length([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert math.isclose(float(forest.average_path_length(256)), 10.2447, abs_tol=1e-3)


def test_grown_tree_separates_its_rows():
    x = np.random.default_rng(0).normal(size=(64, 4))
    tree = forest.grow_tree(x, 1.0, np.random.default_rng(1))
    leaves = tree[tree["feature"] < 0]
    assert leaves["size"].sum() == 64 and tree["depth"].max() <= 6
    assert len(leaves) == (tree["feature"] >= 0).sum() + 1
    inner = tree[tree["feature"] >= 0].set_index("node")
    sizes = tree.set_index("node")["size"]
    assert (sizes[inner["left"]].to_numpy() + sizes[inner["right"]].to_numpy() == inner["size"].to_numpy()).all()
    limited = forest.grow_tree(x, 0.5, np.random.default_rng(1))
    assert limited.loc[limited["feature"] >= 0, "feature"].nunique() <= 2
    assert len(forest.grow_tree(np.zeros((5, 4)), 1.0, np.random.default_rng(1))) == 1


def test_forest_flags_the_planted_outlier(table, fitted):
    scored = fitted.transform(table).toPandas().sort_values("anomaly_score")
    assert scored.iloc[0]["k"] == 7
    assert abs(scored["anomaly_flag"].mean() - 0.05) < 0.01
    assert ((scored["anomaly_score"] < 0) == (scored["anomaly_flag"] == 1)).all()
    assert set(scored["anomaly_label"]) == {"Normal", "Anomaly"}
    assert (fitted.nodes.loc[fitted.nodes["node"] == 0, "size"] == 128).all()


def test_forest_does_not_depend_on_partitions(table, fitted):
    again = forest.fit_forest(table.repartition(11), KEYS, n_estimators=40, max_samples=128, contamination=0.05)
    order = ["tree", "node"]
    a, b = (m.nodes.sort_values(order).reset_index(drop=True) for m in (fitted, again))
    pd.testing.assert_frame_equal(a, b)
    assert math.isclose(fitted.offset, again.offset)


def test_forest_round_trip(spark, table, fitted, tmp_path):
    fitted.save(spark, str(tmp_path / "f"))
    loaded = forest.ForestModel.load(spark, str(tmp_path / "f"))
    a = fitted.transform(table).select("k", "anomaly_score").toPandas().sort_values("k")
    b = loaded.transform(table).select("k", "anomaly_score").toPandas().sort_values("k")
    assert np.array_equal(a["anomaly_score"], b["anomaly_score"])


def test_pool_is_bounded_and_stable(spark):
    df = spark.range(200_000).withColumn("x", F.rand(1))
    pool = forest.draw_pool(df, ["id"], 1000, 3)
    assert 1000 <= pool.count() <= 1700
    assert pool.select("id").exceptAll(forest.draw_pool(df.repartition(9), ["id"], 1000, 3).select("id")).count() == 0


def test_search_covers_the_grid(table):
    grid = {"n_estimators": [5, 10], "max_samples": [32], "max_features": [0.75, 1.0], "contamination": [0.01, 0.1]}
    result, best = forest.search_forest(table, KEYS, grid)
    rows = result.toPandas()
    assert len(rows) == 4 and rows["separation"].max() == rows.set_index(
        ["max_features", "max_samples", "n_estimators"]).loc[
        (best["max_features"], best["max_samples"], best["n_estimators"]), "separation"]
    assert best["contamination"] == 0.01


def test_search_scores_every_forest_in_one_scan_as_each_on_its_own(spark, table):
    """Trees of a setting and the separation of each fold, by plain numpy over one forest at a time."""
    signals = forest.impute_median(forest.add_signals(table), dict.fromkeys(forest.FEATURES, 0.0))
    folded = signals.withColumn("_fold", F.pmod("k", F.lit(2)).cast("int")).select("k", *forest.FEATURES, "_fold")
    pool = forest.draw_pool(folded, ["k"], 10_000, 1).withColumn("_fold", 1 - F.col("_fold"))
    settings = [(6, 32, 1.0), (6, 64, 0.75)]
    nodes = forest.grow_forests(pool, forest.FEATURES, settings, 5)
    alone = forest.grow_forest(pool, forest.FEATURES, 6, 64, 0.75, 5)
    same = ["fold", "tree", "node"]
    pd.testing.assert_frame_equal(nodes[nodes["setting"] == 1].drop(columns="setting").sort_values(same).reset_index(drop=True),
                                  alone.sort_values(same).reset_index(drop=True))
    scores = forest._fold_scores(folded, nodes, [3, 6], 2)
    assert scores.columns == ["_fold", "s0", "s1", "s2", "s3"]
    got = forest._fold_separations(scores, ["s0", "s1", "s2", "s3"], 2)
    frame, want = folded.toPandas(), []
    for setting, (_, rows, _) in enumerate(settings):
        for trees in (3, 6):
            found = []
            for fold in (0, 1):
                mine = nodes[(nodes["setting"] == setting) & (nodes["fold"] == fold) & (nodes["tree"] < trees)]
                x = frame.loc[frame["_fold"] == fold, list(forest.FEATURES)].to_numpy()
                depth = np.concatenate([b.mean(axis=1) for b in forest.path_lengths(x, forest.pack_nodes(mine))])
                s = -np.power(2.0, -depth / forest.average_path_length(rows))
                cut = np.quantile(s, 0.1)
                found.append(s[s > cut].mean() - s[s <= cut].mean())
            want.append(np.mean(found))
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_no_tree_of_a_search_passes_through_the_driver(table, monkeypatch):
    """The published grid has 13 million nodes; they stay in a table, and blocks of rows give the same scores."""
    grid = {"n_estimators": [5, 10], "max_samples": [32], "max_features": [0.75, 1.0], "contamination": [0.01]}
    want = sorted(tuple(r) for r in forest.search_forest(table, KEYS, grid)[0].collect())

    def refused(*_):
        raise AssertionError("trees in the driver")

    monkeypatch.setattr(type(table), "toPandas", refused)
    monkeypatch.setattr(type(table.sparkSession.sparkContext), "broadcast", refused)
    monkeypatch.setattr(forest, "_SCORED_ROWS", 300)
    got = sorted(tuple(r) for r in forest.search_forest(table, KEYS, grid)[0].collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def test_separation_of_few_rows_is_zero(spark):
    assert forest.extreme_separation(spark.range(9).select(F.col("id").cast("double").alias("s")), "s").first()[0] == 0.0
    twenty = spark.range(20).select(F.col("id").cast("double").alias("s"), F.lit(1).alias("g"))
    s = np.arange(20.0)
    want = s[s > np.quantile(s, 0.1)].mean() - s[s <= np.quantile(s, 0.1)].mean()
    assert forest.extreme_separation(twenty, "s").first()[0] == pytest.approx(want)
    assert forest.extreme_separation(twenty, "s", ["g"]).first()["separation"] == pytest.approx(want)


PARAMS = {"n_estimators": 5, "learning_rate": 0.3, "num_leaves": 15, "min_child_samples": 5}


@pytest.fixture(scope="module")
def regressor(table):
    return boosted.fit_with_params(table, PARAMS)


def brute_force(present, share):
    m = len(present)
    out = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for chosen in itertools.combinations(others, k):
                rest = math.prod(present[j] if j in chosen else share[j] for j in others)
                out[i] += math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * rest * (present[i] - share[i])
    return out


def test_leaf_attribution_equals_all_subsets():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 5):
        present, share = rng.integers(0, 2, m).astype(float), rng.random(m)
        assert np.allclose(attribution.shapley(present, share), brute_force(present, share))


@pytest.mark.parametrize("m", [1, 4, 6, 7, 8, 9, 11])
def test_slices_of_a_path_equal_all_subsets(m):
    rng = np.random.default_rng(m)
    present, share, value = rng.random((5, 3, m)) < 0.6, rng.random((3, m)), rng.normal(size=3)
    got = attribution._looked_up(attribution._slices(share, value), present)
    for row in range(5):
        for leaf in range(3):
            assert np.allclose(got[row, leaf], value[leaf] * brute_force(present[row, leaf], share[leaf]))


def test_tables_grow_with_the_leaves_and_not_with_the_depth():
    def size(m):
        slices = attribution._slices(np.full((10, m), 0.5), np.ones(10))
        return sum(v.nbytes for s in slices for v in s.values() if isinstance(v, np.ndarray))

    assert size(6) <= 10 * 3200 and size(40) <= 10 * 40 * 400


def test_boosted_attributions_add_up(table, regressor, monkeypatch):
    explainer = attribution.explain_boosted(regressor, table)
    rows = boosted.predict(regressor, table)
    got = attribution.shap_matrix(explainer, rows, ["k", "prediction"]).toPandas()
    assert np.allclose(got["output"], got["prediction"], atol=1e-6)
    shap = np.stack(got["shap"])
    used = {n for g in explainer.ensemble.groups for n in np.unique(g["feature"])}
    unused = [i for i in range(shap.shape[1]) if i not in used]
    assert len(unused) and not shap[:, unused].any()
    monkeypatch.setattr(attribution, "_WHOLE", 1)
    sliced = attribution.explain_boosted(regressor, table)
    x = np.stack(got["values"])[:200]
    assert max(len(g["slices"]) for g in sliced.ensemble.groups) > 1
    assert np.allclose(sliced.ensemble.explain(x), explainer.ensemble.explain(x))
    importance = attribution.shap_importance(explainer.long(table, ["k"])).collect()
    assert importance[0]["feature"] == "numeric__quantity_sum_mean_7d"
    assert len(importance) == len(explainer.names) == 22 + 5


def test_forest_attributions_add_up(table, fitted):
    explainer = attribution.explain_forest(fitted)
    got = attribution.shap_matrix(explainer, table, ["k"]).toPandas().sort_values("k")
    scored = fitted.normality(table).select("k", "_normality").toPandas().sort_values("k")
    depth = -np.log2(-scored["_normality"]) * float(forest.average_path_length(128))
    assert np.allclose(got["output"], depth, atol=1e-6)
    top = attribution.explain_anomaly_drivers(explainer, fitted.transform(table), 3, 2).collect()
    assert len(top) == 3 and abs(top[0]["top_driver_1_shap"]) >= abs(top[0]["top_driver_2_shap"])
    one = attribution.force_data(explainer, table, {"k": 7}).collect()
    assert len(one) == 4 and math.isclose(one[0]["base_value"], explainer.base)


def test_feature_names_resolve(table, regressor):
    explainer = attribution.explain_boosted(regressor, table)
    assert attribution.resolve_feature(explainer, "avg_ticket") == "numeric__avg_ticket"
    assert attribution.resolve_feature(explainer, "Product_p2") == "categorical__Product_p2"
    with pytest.raises(ValueError):
        attribution.resolve_feature(explainer, "quantity")


def test_waterfall_ends_at_the_prediction(table, regressor):
    explainer = attribution.explain_boosted(regressor, table)
    rows = boosted.predict(regressor, table, "hybrid").withColumn("base", F.lit(100.0))
    steps = attribution.waterfall_critical(explainer, rows, ["k"], "quantity_sum", "base", "hybrid", 2, 4).toPandas()
    assert steps.groupby("k").size().tolist() == [4, 4] and set(steps["feature"]) >= {"other"}
    for _, case in steps.groupby("k"):
        case = case.sort_values("rank", ascending=False)
        assert case.iloc[0]["feature"] == "other" and math.isclose(case.iloc[0]["start_value"], explainer.base)
        assert math.isclose(case.iloc[-1]["end_value"], case.iloc[-1]["hybrid_prediction"], abs_tol=1e-6)
    force = attribution.force_data_critical(explainer, rows, ["k"], "quantity_sum", "base", "hybrid", 2, 4)
    assert force.count() == 8
    ranked = attribution.rank_drivers(explainer, table, ["k"], 2).where("k = 5").orderBy("rank").collect()
    assert abs(ranked[0]["shap"]) >= abs(ranked[1]["shap"])


def test_unknown_and_missing_inputs_are_handled(table, regressor):
    odd = table.limit(2).withColumns({"Product": F.lit("never seen"), "avg_ticket": F.lit(None).cast("double")})
    ready = PipelineModel(regressor.stages[:-1]).transform(odd).first()["features"].toArray()
    names, raw = boosted.feature_names(regressor)
    assert not ready[[i for i, r in enumerate(raw) if r == "Product"]].any()
    assert not np.isnan(ready).any() and len(names) == len(ready)
    missing = table.limit(1).withColumn("Product", F.lit(None).cast("string"))
    usual = boosted.most_frequent(table, "Product")
    filled = PipelineModel(regressor.stages[:-1]).transform(missing).first()["features"].toArray()
    assert filled[names.index(f"categorical__Product_{usual}")] == 1.0


def test_most_frequent_prefers_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert boosted.most_frequent(df, "c") == "a"


def test_search_and_round_trip(table, tmp_path):
    grid = {"n_estimators": [2, 4], "learning_rate": [0.3], "num_leaves": [7], "min_child_samples": [5]}
    model, result, best = boosted.fit_with_search(table, grid, key_cols=["k"])
    rows = result.toPandas()
    assert rows.loc[rows["best"], "rmse"].iloc[0] == rows["rmse"].min() and best["n_estimators"] == 4
    model.write().save(str(tmp_path / "m"))
    again = boosted.predict(PipelineModel.load(str(tmp_path / "m")), table)
    assert again.join(boosted.predict(model, table, "was").select("k", "was"), "k").where("was <> prediction").count() == 0


def test_equal_settings_share_a_fit_and_fewer_trees_are_a_prefix(table, monkeypatch):
    fits, real = [], boosted.GBTRegressor.fit
    monkeypatch.setattr(boosted.GBTRegressor, "fit", lambda self, *a: fits.append(1) or real(self, *a))
    grid = {**boosted.PARAM_GRID, "n_estimators": [2, 3], "learning_rate": [0.3], "min_child_samples": [5], "num_leaves": [3, 7]}
    _, result, best = boosted.fit_with_search(table, grid, key_cols=["k"], folds=2)
    rows = result.toPandas()
    assert len(rows) == 12 and len(fits) == 2 * 2 + 1
    assert (rows.groupby(["n_estimators", "num_leaves"])["rmse"].nunique() == 1).all()
    assert rows.loc[rows["best"], "rmse"].iloc[0] == rows["rmse"].min() and best["n_estimators"] == 3
    # One combination by hand: a model of two trees, fitted without a fold and measured on it.
    fold = F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(2)).cast("int")
    params = {"n_estimators": 2, "learning_rate": 0.3, "num_leaves": 7, "min_child_samples": 5, "colsample_bytree": 0.8}
    errors = []
    for f in (0, 1):
        model = boosted.fit_with_params(table.where(fold != f), params)
        miss = F.col("prediction") - F.col(boosted.TARGET)
        errors.append(math.sqrt(boosted.predict(model, table.where(fold == f)).agg(F.avg(miss * miss)).first()[0]))
    got = rows[(rows["n_estimators"] == 2) & (rows["num_leaves"] == 7)]["rmse"].iloc[0]
    assert got == pytest.approx(np.mean(errors), rel=0.02)


def test_the_hybrid_search_covers_the_published_grid(spark, table, monkeypatch):
    """Two combinations of four trees were compared; here 150 and 200 trees stand as 1 and 2, all else is the query's."""
    import duckdb
    from workload import models, registry

    names = list(boosted.PARAM_GRID)
    wanted = [(i, *map(float, c)) for i, c in enumerate(itertools.product(*boosted.PARAM_GRID.values()))]
    assert len(wanted) == 48
    listed = duckdb.sql(registry.ORACLES["hybrid_fit"])
    assert listed.columns == ["combination", *names, "has_error", "best_has_least"]
    assert sorted(listed.fetchall()) == [(*w, True, True) for w in wanted]
    rows = table.withColumns({"Order_Date": F.add_months("Order_Date", -300), "anomaly_score": F.lit(0.1), "anomaly_flag": F.lit(0)})
    monkeypatch.setattr(models, "scored_table", lambda *_: rows)
    settings, fits, real = boosted.tree_params, [], boosted.GBTRegressor.fit
    monkeypatch.setattr(boosted, "tree_params", lambda p: {**settings(p), "maxIter": {150: 1, 200: 2}[p["n_estimators"]]})
    monkeypatch.setattr(boosted.GBTRegressor, "fit", lambda self, *a: fits.append(1) or real(self, *a))
    found = models.hybrid_fit(spark, "unused")
    assert found.columns == listed.columns
    assert sorted(map(tuple, found.collect())) == [(*w, True, True) for w in wanted]
    assert len(fits) == 3 * 8 + 1


def test_each_fold_is_imputed_by_the_others(spark):
    """Fold 2 is extreme, so the medians without it differ from those of all rows."""
    rows = [(f, 1000.0 if f == 2 else float(i), "z" if f == 2 else "a") for f in range(3) for i in range(11 + 30 * (f == 2))]
    df = spark.createDataFrame([*rows, (0, None, None)], "_fold int, x double, c string")
    got = boosted.learn_fold_imputation(df, ["x"], ["c"], "_fold", [0, 1, 2])
    assert got == {0: {"x": 1000.0, "c": "z"}, 1: {"x": 1000.0, "c": "z"}, 2: {"x": 5.0, "c": "a"}}
    assert boosted.learn_imputation(df, ["x"], ["c"]) == {"x": 1000.0, "c": "z"}
    none = boosted.learn_fold_imputation(df.where("_fold = 1"), ["x"], ["c"], "_fold", [1])
    assert none == {1: {"x": 0.0, "c": ""}}


def test_grid_settings_map_to_tree_settings():
    assert boosted.tree_params(boosted.BEST_PARAMS)["maxDepth"] == 6
    assert boosted.tree_params({"num_leaves": 63, "max_depth": 4})["maxDepth"] == 4


def test_complete_run(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    days = pd.date_range("2021-01-01", "2022-12-31")
    rows = [sale(i, rng.choice(["p", "q"]), "n", str(rng.choice(days))[:10], float(rng.integers(1, 30))) for i in range(1500)]
    built = plans.write_features(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "features"))
    one_year = by_year(built, 2021, year_col="year")
    assert "PartitionFilters: [isnotnull(year" in one_year._jdf.queryExecution().executedPlan().toString()
    assert one_year.count() == built.where("year(Order_Date) = 2021").count()
    _, scored = plans.write_scores(built, [2021], str(tmp_path / "scored"),
                                   {"n_estimators": 20, "max_samples": 64, "contamination": 0.05})
    assert scored.count() == built.count()
    calls = []
    for name in ("join_scores", "learn_imputation"):
        monkeypatch.setattr(plans, name, lambda *a, real=getattr(plans, name), name=name: calls.append(name) or real(*a))
    result = plans.compare_models(built, scored, [2021], [2022], PARAMS)
    assert calls == ["join_scores", "learn_imputation"]
    seen = result.predictions._jdf.queryExecution().executedPlan().toString()
    assert seen.count("FileScan") == 1  # written once, with both predictions
    report = result.report.toPandas()
    assert report["count"].sum() == built.where("year = 2022").count()
    assert (report["baseline_mae"] >= 0).all()


def test_registered_fits_use_the_published_setting():
    from workload import models
    used = boosted.tree_params(models.TREES)
    assert (used["maxIter"], used["maxDepth"], used["stepSize"]) == (200, 6, 0.08)


def test_a_stored_fit_is_read_and_not_made_again(spark, tmp_path, monkeypatch):
    """A later session reads what was published; other parameters or an attempt cut short are made anew."""
    from workload import registry

    monkeypatch.setattr(registry, "durable_folder", lambda _: str(tmp_path))
    made = []

    def fitted(parameters):
        def make():
            made.append(parameters)
            return spark.range(3).withColumn("p", F.lit(repr(parameters)))

        registry._MADE.clear()  # what a new session starts with
        return registry.stored_table(spark, "/root/testdata/sf0.001", "trial", parameters, make)

    try:
        first = sorted(fitted({"a": 1}).collect())
        assert sorted(fitted({"a": 1}).collect()) == first and made == [{"a": 1}]
        assert fitted({"a": 2}).first()["p"] == "{'a': 2}" and made == [{"a": 1}, {"a": 2}]
        # An attempt without a published path is no fit.
        for marker in tmp_path.glob("fits/*/published"):
            marker.rename(marker.with_name("lost"))
        assert sorted(fitted({"a": 1}).collect()) == first and made[2:] == [{"a": 1}]
    finally:
        registry._MADE.clear()


def test_the_feature_table_of_the_fits_needs_no_written_sales(spark, tmp_path, monkeypatch):
    """All sales were written and read again for it, and its few rows were then cut as finely as the sales."""
    from ledgerlens import session
    from workload import models, registry, views

    sf = "/root/testdata/sf0.001"
    wanted = views.features(spark, sf)
    settings = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n, None) for n in settings]
    monkeypatch.setattr(registry, "durable_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 30)
    made = dict(registry._MADE)
    registry._MADE.clear()
    monkeypatch.setattr(registry, "materialise", lambda *_: pytest.fail("the sales were written"))
    try:
        found = models.feature_table(spark, sf)
        assert [spark.conf.get(n, None) for n in settings] == before
        keys, counts = ["Product", "Region", "Order_Date"], ["order_count", "customer_count", "quantity_sum"]
        assert found.count() == wanted.count() > 0 and found.dtypes == wanted.dtypes
        assert found.select(*keys, *counts).exceptAll(wanted.select(*keys, *counts)).count() == 0
    finally:
        registry._MADE.clear()
        registry._MADE.update(made)


def test_the_version_of_the_inputs_is_found_without_their_rows(spark, tmp_path):
    """Every row of every table was scanned for the names of its files, in each session."""
    from workload import registry

    for name in registry.SOURCE_TABLES:
        (tmp_path / f"{name}.parquet").write_bytes(b"no rows are read")
    first = registry.input_version(spark, str(tmp_path))
    assert registry.input_version(spark, str(tmp_path)) == first
    (tmp_path / "orders.parquet").write_bytes(b"one more file length")
    assert registry.input_version(spark, str(tmp_path)) != first
