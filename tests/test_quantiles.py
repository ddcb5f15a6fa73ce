import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quantiles as qt


def table(spark, x, name="v"):
    return spark.createDataFrame([(float(v),) for v in x], f"{name} double").repartition(4)


def slots_of(spark, df, monkeypatch, probs):
    """Rows of each slot of `exact_quantiles`, below the brackets left out."""
    seen = {}
    real = qt._running

    def spy(rows, keys, order, size):
        if order == "_slot":
            seen["slots"] = rows.where("_slot >= 0").collect()
        return real(rows, keys, order, size)

    monkeypatch.setattr(qt, "_running", spy)
    found = qt.exact_quantiles(df.withColumn("g", F.lit(1)), "v", probs, ["g"], bounded_groups=True).first()
    return found, seen["slots"]


def test_extreme_values_do_not_gather_a_bracket_in_one_slot(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(0).normal(size=200_000), [-1e12] * 3])
    found, slots = slots_of(spark, table(spark, x), monkeypatch, {"q": 0.004})
    assert found["q"] == pytest.approx(np.quantile(x, 0.004), rel=1e-12)
    sizes = [r["_slot_rows"] for r in slots]
    assert len(sizes) > 50 and max(sizes) <= 0.05 * sum(sizes)


@pytest.mark.parametrize("few", [50, 10_000])
def test_columns_equal_numpy_however_often_brackets_are_narrowed(spark, monkeypatch, few):
    monkeypatch.setattr(qt, "_FEW", few)
    rng = np.random.default_rng(1)
    n = 40_000
    columns = {
        "a": rng.normal(size=n), "b": np.concatenate([np.full(n - 3, 5.0), [-1e12, 7.0, 1e12]]),
        "c": np.where(rng.random(n) < 0.5, 5.0, rng.random(n) * 3 + 5), "d": rng.integers(0, 4, n).astype(float),
        "e": np.exp(rng.normal(size=n) * 9), "f": np.concatenate([np.full(n // 2, 1.0), np.full(n // 2, 2.0)]),
    }
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()])), ", ".join(f"{c} double" for c in columns)).repartition(4).cache()
    ps = [0.0, 0.004, 0.25, 0.5, 0.75, 1.0]
    got = qt.column_quantiles(df, list(columns), ps)
    for c, x in columns.items():
        assert np.allclose(got[c], np.quantile(x, ps), rtol=1e-12), c
    df.unpersist()


def test_the_number_of_jobs_does_not_grow_with_the_columns(spark, monkeypatch):
    monkeypatch.setattr(qt, "_FEW", 100)
    rng = np.random.default_rng(2)
    names = [f"c{i}" for i in range(22)]
    df = spark.createDataFrame(rng.normal(size=(30_000, 22)).tolist(), ", ".join(f"{c} double" for c in names)).repartition(4).cache()
    df.count()

    def jobs(columns):
        sc = spark.sparkContext
        sc.setJobGroup(f"q{len(columns)}", "")
        qt.column_quantiles(df, columns, [0.5])
        found = len(sc.statusTracker().getJobIdsForGroup(f"q{len(columns)}"))
        sc._jsc.clearJobGroup()
        return found

    assert jobs(names) <= jobs(names[:1]) + 1
    df.unpersist()


def test_the_largest_sorted_slot_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(qt, "_MOST", 200)
    sorted_rows, real = [], qt._running

    def spy(rows, keys, order, size):
        if order == "_value":
            sorted_rows.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return real(rows, keys, order, size)

    monkeypatch.setattr(qt, "_running", spy)
    rng = np.random.default_rng(7)
    for n in (10_000, 80_000):
        x = np.concatenate([rng.normal(size=n), np.full(n // 4, 0.5), [1e12, -1e12]])
        g = rng.choice(["a", "b", None], len(x), p=[0.6, 0.3, 0.1])
        df = spark.createDataFrame(list(zip(x.tolist(), g.tolist())), "v double, g string").repartition(4)
        got = qt.exact_quantiles(df, "v", {"low": 0.1, "mid": 0.5, "top": 0.97}, ["g"], accuracy=100).collect()
        for r in got:
            want = np.quantile(x[[v == r["g"] for v in g]], [0.1, 0.5, 0.97])
            assert np.allclose([r["low"], r["mid"], r["top"]], want, rtol=1e-12), r
    assert len(sorted_rows) == 2 and max(sorted_rows) <= 50
