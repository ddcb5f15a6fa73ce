"""The sales, prediction and sensor tables that the queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import session
from ledgerlens.operators.daily import daily_metrics, fill_missing_days
from ledgerlens.operators.features import build_features
from workload.registry import written

SALES_KEY = ["Order_ID", "line_no", "part_no", "supp_no", "ext_price"]
SEGMENTS_B2B = ("AUTOMOBILE", "BUILDING", "MACHINERY")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """The sales table: joined once per session and written, as every query reads it."""
    return written(spark, sf, "sales", lambda: joined_sales(spark, sf), session.ROWS_PER_TASK)


def joined_sales(spark: SparkSession, sf: str, steps: int = 1) -> DataFrame:
    """Order lines as sales of a brand in a region.

    Customers meet the orders, which are a quarter of the lines, before these meet the lines; so the lines
    are dealt out for their orders and their parts only, and while they are narrow first. `steps` counts the
    join and what follows it in the same task.
    """
    session.split_hot_keys(spark)
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    session.bounded_tasks(spark, line.count(), steps)
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    business = F.col("c_mktsegment").isin(*SEGMENTS_B2B)
    discount = F.when(business, F.col("l_discount") + 0.0).otherwise(0.0)
    price = F.floor(F.col("p_retailprice") * F.col("l_quantity") * (1 - discount) * 100 + 0.5) / 100
    return joined.select(
        F.col("o_orderkey").alias("Order_ID"), F.col("o_custkey").alias("Customer_ID"),
        F.when(business, "B2B").otherwise("B2C").alias("Customer_Type"),
        F.col("p_brand").alias("Product"), F.col("p_type").alias("Category"),
        F.col("p_retailprice").alias("Unit_Price"), F.col("l_quantity").alias("Quantity"),
        discount.alias("Discount"), price.alias("Total_Price"),
        F.col("r_name").alias("Region"), F.col("o_orderdate").alias("Order_Date"),
        F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("supp_no"), F.col("l_extendedprice").alias("ext_price"),
    )


def _every(k, n):
    return k % n == 0


def sales_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with text cells, wrong values and copies, so that every quality rule has work to do."""
    k = F.col("Order_ID") * 7 + F.col("line_no")
    spoilt = sales(spark, sf).withColumn("k", k)
    k = F.col("k")
    spoilt = spoilt.select(
        "Order_ID", "Customer_ID",
        F.when(_every(k, 89), "X").when(_every(k, 97), F.lit(None)).otherwise(F.col("Customer_Type"))
        .alias("Customer_Type"),
        "Product", "Category", "Unit_Price",
        F.when(_every(k, 53), F.lit(None)).when(_every(k, 59), "n/a").when(_every(k, 61), "-3")
        .otherwise(F.col("Quantity").cast("int").cast("string")).alias("Quantity"),
        F.when(_every(k, 67), F.lit(None)).when(_every(k, 71), -0.05).when(_every(k, 73), 1.5)
        .when(_every(k, 79), 0.02).otherwise(F.col("Discount")).alias("Discount"),
        F.when(_every(k, 83), F.col("Total_Price") + 5.0).otherwise(F.col("Total_Price")).alias("Total_Price"),
        "Region",
        F.when(_every(k, 101), "bad-date").otherwise(F.col("Order_Date").cast("date").cast("string"))
        .alias("Order_Date"),
        F.when(_every(k, 103), 2).otherwise(1).alias("copies"),
    )
    return spoilt.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def sales_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sales in which some total prices are missing."""
    k = F.col("Order_ID") * 7 + F.col("line_no")
    return sales(spark, sf).withColumn("Total_Price", F.when(k % 7 != 0, F.col("Total_Price")))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_metrics(sales(spark, sf))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return fill_missing_days(daily(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(sales(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Daily quantities with two stand-in predictions and a flag, so that reports need no model."""
    q = F.col("quantity_sum")
    return daily(spark, sf).withColumns({
        "baseline_pred": q * 0.9 + 1.0, "anomaly_pred": q * 0.95 + 0.5,
        "anomaly_flag": F.when(q > 40, 1).otherwise(0)})


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with a stand-in score and flag."""
    score = F.lit(0.1) - F.col("quantity_sum") / 400
    flag = (score < 0).cast("int")
    return features(spark, sf).withColumns({
        "anomaly_score": score, "anomaly_flag": flag,
        "anomaly_label": F.when(flag == 1, "Anomaly").otherwise("Normal")})


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sensor runs: a user is a run, an event type a sensor, an hour a file."""
    types = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.date_format("ts", "yyyy.MM.dd.HH.00.00").alias("file_name"),
        sensor_number(F.col("event_type"), types).alias("sensor"),
        "value",
    )


def sensor_number(c, names):
    number = F.lit(None).cast("int")
    for i, n in enumerate(names):
        number = F.when(c == n, i + 1).otherwise(number)
    return number
