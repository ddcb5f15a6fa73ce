import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ordered
from ledgerlens.operators.quantiles import column_quantiles, exact_quantiles, robust_center_scale
from ledgerlens.operators import quantiles


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows, and a third of all rows are copies of one row."""
    rng = np.random.default_rng(1)
    n = 3000
    frame = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
        "x": np.round(rng.normal(size=n), 3), "z": np.where(rng.random(n) < 0.7, 0.0, rng.integers(1, 9, n))})
    frame.loc[: n // 3, ["g", "x", "z"]] = ["a", 0.5, 0.0]
    return frame.assign(k=np.arange(n))


def test_positions_follow_the_order(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = ordered.with_position(df, ["g", "x", "k"], unique=True).toPandas().sort_values("_position")
    assert got["_position"].tolist() == list(range(len(skewed)))
    assert got["k"].tolist() == skewed.sort_values(["g", "x", "k"])["k"].tolist()


def test_positions_of_copies_are_distinct_and_complete(spark, skewed):
    df = spark.createDataFrame(skewed[["g", "x", "z"]]).repartition(5)
    got = ordered.with_position(df, ["g", "x"]).toPandas().sort_values("_position")
    assert got["_position"].tolist() == list(range(len(skewed)))
    assert got["x"].tolist() == skewed.sort_values(["g", "x"])["x"].tolist()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_blocks_give_the_same_frames_as_one_window(spark, skewed, rows):
    placed = ordered.with_position(spark.createDataFrame(skewed).repartition(3), ["x", "k"], unique=True)
    blocked = ordered.in_blocks(placed, before=3, after=2, rows=rows)
    total = F.sum("x").over(ordered.block_window().rowsBetween(-3, 2))
    got = ordered.own_rows(blocked.withColumn("t", total), keep_position=True).toPandas().sort_values("_position")
    x = skewed.sort_values(["x", "k"])["x"].to_numpy()
    want = [x[max(0, i - 3):i + 3].sum() for i in range(len(x))]
    assert np.allclose(got["t"], want)


@pytest.mark.parametrize("accuracy", [2000, 100])
def test_grouped_quantiles_match_pandas(spark, skewed, accuracy):
    df = spark.createDataFrame(skewed).repartition(6)
    for column in ("x", "z"):
        got = exact_quantiles(df, column, {"a": 0.25, "b": 0.5, "c": 0.99}, ["g"], accuracy).toPandas()
        want = skewed.groupby("g")[column].quantile([0.25, 0.5, 0.99]).unstack()
        assert np.allclose(got.sort_values("g")[["a", "b", "c"]], want)


def test_quantiles_of_small_and_empty_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 7.0), ("c", None), (None, 2.0), ("d", float("nan"))], "g string, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "x", {"q": 0.25}, ["g"]).collect()}
    assert got == {"a": 1.5, "b": 7.0, None: 2.0}


def test_column_quantiles_match_pandas(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed).repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for limit in (10 ** 6, 10):
        monkeypatch.setattr(quantiles, "_FEW", limit)
        got = column_quantiles(df, ["x", "z"], probs, accuracy=300)
        for c in ("x", "z"):
            assert np.allclose(got[c], skewed[c].quantile(probs))


def test_center_and_scale(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (2.0, None, 4.0), (None, None, 4.0), (9.0, None, 4.0)],
                               "x double, empty double, flat double")
    medians, scales = robust_center_scale(df, ["x", "empty", "flat"])
    filled = pd.Series([1.0, 2.0, 2.0, 9.0])
    assert medians == {"x": 2.0, "empty": 0.0, "flat": 4.0}
    assert scales == {"x": filled.quantile(0.75) - filled.quantile(0.25), "empty": 1.0, "flat": 1.0}
