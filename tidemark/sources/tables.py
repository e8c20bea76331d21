"""Parquet scans with declared schemas, and the transaction feeds built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared schemas; zone-less file timestamps are read as UTC instants.
SCHEMAS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double,"
    " props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}
EVENT_PROPS = "k int"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Short-horizon transactions: one per event, merchant taken from the JSON properties."""
    props = F.from_json("props", EVENT_PROPS)
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        props["k"].cast("string").alias("merchant_id"),
        F.col("value").alias("amount"),
        F.col("ts").alias("event_ts"),
        "event_type",
        (F.col("event_type") == "error").alias("is_chargeback"),
    )


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Long-horizon transactions: one per order."""
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("event_ts"),
        (F.col("o_orderstatus") == "F").alias("is_chargeback"),
    )


def line_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """User by merchant transactions: one per order line, the supplier being the merchant."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderdate").alias("event_ts"),
        (F.col("l_returnflag") == "R").alias("is_refund"),
        (F.col("l_returnflag") == "A").alias("is_dispute"),
    )


def warehouse_until(spark: SparkSession, name: str, as_of: Column, ts: str = "event_ts") -> DataFrame:
    """A catalog table's rows up to an instant; the filter reaches the scan."""
    return spark.table(name).where(F.col(ts) <= as_of)
