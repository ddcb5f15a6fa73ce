import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.operators import anomalies, evaluation, joins
from ledgerlens.sources import signals, tables

SCORED = "Product string, Region string, Order_Date date, anomaly_flag int, anomaly_score double, total_price_sum double"


@pytest.fixture(scope="module")
def scored(spark):
    return spark.sql(f"""select * from values ('p', 'n', date'2022-01-01', 1, -0.3D, 5.0D), ('p', 'n', date'2022-01-02', 0, 0.1D, 2.0D),
     ('q', 'n', date'2022-01-01', 1, -0.3D, 7.0D), ('q', cast(null as string), date'2022-01-01', 0, 0.2D, 1.0D),
     ('p', 's', date'2022-01-01', 1, -0.9D, 1.0D) as t({', '.join(c.split()[0] for c in SCORED.split(', '))})""")


def test_summary_keeps_null_keys(scored):
    got = {(r["Product"], r["Region"]): (r["total_rows"], r["anomaly_count"], r["anomaly_rate"])
           for r in anomalies.anomaly_summary(scored).collect()}
    assert got == {("p", "n"): (2, 1, 0.5), ("q", "n"): (1, 1, 1.0), ("q", None): (1, 0, 0.0), ("p", "s"): (1, 1, 1.0)}


def test_top_anomalies_with_ties(scored):
    got = [(r["Product"], r["Region"]) for r in anomalies.top_anomalies(scored, 2).collect()]
    assert got == [("p", "s"), ("p", "n")]
    assert anomalies.top_anomalies(scored, 5, product="q").count() == 1
    with pytest.raises(ValueError):
        anomalies.top_anomalies(scored.drop("anomaly_flag"))


def test_timeseries(scored):
    assert anomalies.anomaly_timeseries(scored, region="n").count() == 3
    assert {r["Product"] for r in anomalies.anomaly_timeseries_by_group(scored, max_groups=1).collect()} == {"p"}
    with pytest.raises(ValueError):
        anomalies.anomaly_timeseries_by_group(scored, "Category")


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "id int, quantity_sum double, anomaly_flag int, baseline_pred double, anomaly_pred double")


def test_align_rejects_repeated_keys(spark):
    p = _predictions(spark, [(1, 2.0, 0, 1.0, 2.0), (2, 2.0, 1, 1.0, 2.0)])
    assert joins.align_models(p, p, ["id"]).count() == 2
    twice = p.union(p)
    with pytest.raises(PySparkException, match="repeated key"):
        joins.align_models(twice, p, ["id"]).collect()


def test_align_by_order(spark):
    p = _predictions(spark, [(3, 9.0, 0, 1.0, 2.0), (1, 7.0, 1, 4.0, 5.0)])
    shifted = p.withColumn("id", F.col("id") + 100)
    got = [tuple(r) for r in joins.align_by_order(p, shifted, ["id"], ["id"]).orderBy("row").collect()]
    assert got == [(0, 7.0, 1, 4.0, 5.0), (1, 9.0, 0, 1.0, 2.0)]
    with pytest.raises(ValueError):
        joins.align_by_order(p.limit(1), p, ["id"], ["id"])


def test_segment_report_with_perfect_baseline(spark):
    p = _predictions(spark, [(1, 2.0, 0, 2.0, 1.0), (2, 4.0, 0, 4.0, 4.0), (3, 4.0, None, 4.0, 4.0)])
    report = evaluation.segment_report(p).collect()
    assert len(report) == 1
    assert report[0]["mae_improvement"] == -0.5 and report[0]["mae_improvement_pct"] == 0.0
    bars = evaluation.model_comparison_bars(evaluation.segment_report(p), "mae").collect()
    assert [(b["group_label"], b["model"], b["value"]) for b in bars] == [
        ("Normal", "Baseline", 0.0), ("Normal", "With Anomaly Features", 0.5)]
    with pytest.raises(ValueError):
        evaluation.model_comparison_bars(evaluation.segment_report(p), "r2")


def test_critical_corrections_only_hold_improvements(spark):
    p = _predictions(spark, [(1, 2.0, 0, 0.0, 2.0), (2, 4.0, 0, 4.0, 0.0), (3, 9.0, 0, 0.0, 7.0)])
    got = evaluation.critical_corrections(p, "quantity_sum", "baseline_pred", "anomaly_pred", 5, ["id"]).collect()
    assert [r["id"] for r in got] == [3, 1]


def test_join_collision_gets_suffixes(spark):
    sales = spark.createDataFrame([("p", "r", "2022-01-01", "a")], "Product string, Region string, Order_Date string, Category string")
    joined = joins.join_feature_keys(sales, sales.withColumn("Category", F.lit("b")))
    assert joined.select("Category_x", "Category_y").first() == ("a", "b")


def test_parquet_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, float("nan"))], "k int, s string, x double")
    path = str(tmp_path / "t")
    tables.sink_parquet(df, path)
    with pytest.raises(PySparkException):
        tables.sink_parquet(df, path, overwrite=False)
    back = tables.scan_parquet(spark, path, ["k", "x"])
    assert back.columns == ["k", "x"] and back.where("x is null").count() == 1
    with pytest.raises(PySparkException):
        tables.scan_parquet(spark, str(tmp_path / "missing"))
    clean = df.where("k = 1")
    clean.write.option("header", True).csv(str(tmp_path / "c"))
    assert tables.scan_csv(spark, str(tmp_path / "c")).dtypes == [("k", "int"), ("s", "string"), ("x", "double")]
    assert tables.scan_csv(spark, str(tmp_path / "c"), "k int, s int, x double").first()["s"] is None


def test_roundtrip_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    same = tables.roundtrip_difference(a, a.repartition(3)).first()
    assert tuple(same) == (0, 0, True)
    other = tables.roundtrip_difference(a, spark.createDataFrame([(1,), (3,)], "k int")).first()
    assert tuple(other) == (2, 1, True)


def test_export_and_profile(spark, scored, tmp_path):
    path = str(tmp_path / "top")
    tables.export_top_anomalies(scored, path, 2)
    assert tables.scan_csv(spark, path).count() == 2
    profile = {r["column_name"]: r["non_null_rows"] for r in tables.schema_profile(scored).collect()}
    assert profile["Region"] == 4 and profile["Product"] == 5


def test_sensor_files(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    (run / "2003.10.22.12.06.24").write_text("1.0\t2.0  3 4 5\n-1.0 2.0 3 x 5\n\n")
    (run / "2003.10.22.12.16.24").write_text("3 4 5 6 7\n")
    (run / "notes.txt").write_text("8 8 8 8\n")
    read = signals.scan_signal_files(spark, str(run), max_sensors=4)
    assert read.count() == 16 and {r["folder"] for r in read.collect()} == {"run1"}
    out = signals.sensor_run_features(read.withColumn("run_id", F.lit("r1"))).orderBy("time_index").collect()
    assert [r["file_name"] for r in out] == ["2003.10.22.12.06.24", "2003.10.22.12.16.24", "notes.txt"]
    assert [r["RUL"] for r in out] == [2, 1, 0] and out[2]["timestamp"] is None
    assert out[0]["s1_std"] == 1.0 and out[0]["s1_rms"] == 1.0 and out[0]["s4_mean"] == 4.0 and "s5_mean" not in out[0]


def test_packed_signals_are_few_files_with_every_step(spark, tmp_path):
    path = str(tmp_path / "packed")
    steps = [(i % 700, f"f{i % 3}", float(i) if i % 10 else None) for i in range(2100)] + [(None, "f0", 1.5), (1, None, 2.5)]
    df = spark.createDataFrame(steps, "run long, file string, x double").coalesce(2).withColumn("y", F.col("x") / 3)
    signals.sink_packed_signals(df, path, "run", "file", ["x", "y"])
    assert len(list((tmp_path / "packed").glob("part-*"))) == 2
    back = signals.scan_packed_signals(spark, path)
    want = df.select(F.col("run").cast("string").alias("folder"), F.col("file").alias("file_name"), F.posexplode(F.array("x", "y")).alias("i", "value")) \
        .select("folder", "file_name", (F.col("i") + 1).cast("int").alias("sensor"), "value")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert signals.scan_packed_signals(spark, path, max_sensors=1).count() == 2102


def test_registered_signal_queries_do_not_write_a_file_per_step(spark, tmp_path, monkeypatch):
    """One folder per run, or one per run and hour, had thousands of files at the smallest scale."""
    from workload import tables as queries

    monkeypatch.setattr(queries, "path_for", lambda _, label: str(tmp_path / label))
    for query in (queries.scan_signal_files, queries.sensor_files_to_features):
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert len(list(tmp_path.rglob("part-*"))) <= 16


def test_sales_lines_are_not_dealt_out_by_customer(spark):
    from workload import views

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.joined_sales(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    top = next(i for i, line in enumerate(plan) if "hashpartitioning(o_custkey" in line)
    below = [line for line in plan[top + 1:]]
    end = next((i for i, line in enumerate(below) if depth(line) <= depth(plan[top])), len(below))
    assert "o_orderkey" in "".join(below[:end]) and "l_orderkey" not in "".join(below[:end])


def test_predicates_on_measures_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.sink_parquet(spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k int, x double"), path)
    plan = tables.scan_parquet(spark, path).where("x > 1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,1.0)" in plan.split("PushedFilters:")[1].split("]")[0]
    assert tables.scan_parquet(spark, path).where("x is null").count() == 1
    spark.createDataFrame([(float("nan"),)], "x double").write.parquet(str(tmp_path / "u"))
    assert tables.scan_parquet(spark, str(tmp_path / "u"), nan_as_null=True).first()["x"] is None
