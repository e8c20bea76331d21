"""Inputs the registered queries share, as Spark frames and as the matching SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import apply_settings, work_folder
from tidemark.sources.tables import event_transactions, line_transactions, read_table

Query = Callable[[SparkSession, str], DataFrame]

# Same columns as sources.tables, for use as common table expressions.
EVENT_TXNS = """events_t AS (
  SELECT event_id AS transaction_id, CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS merchant_id, value AS amount, ts AS event_ts,
         event_type, event_type = 'error' AS is_chargeback
  FROM events)"""
ORDER_TXNS = """orders_t AS (
  SELECT o_orderkey AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
         o_totalprice AS amount, o_orderdate AS event_ts, o_orderstatus = 'F' AS is_chargeback
  FROM orders)"""
LINE_TXNS = """lines_t AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(l_suppkey AS VARCHAR) AS merchant_id, l_extendedprice AS amount,
         o_orderdate AS event_ts, l_returnflag = 'R' AS is_refund, l_returnflag = 'A' AS is_dispute
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
# Of a double's 53 bits this keeps 31, that is nine digits, by plain double arithmetic: sums taken in
# another order are equal then.
KEPT_BITS = 2.0**22 + 1


def exact(column: str, rest: str = "") -> str:
    """A plain sum of doubles, with compensation for rounding."""
    return f"fsum({column}) {rest}"


def nine(columns: str, query: Query) -> Query:
    """The query with the named double columns at nine digits."""

    def rounded(spark: SparkSession, folder: str) -> DataFrame:
        kept = {}
        for name in columns.split():
            wide = F.col(name) * F.lit(KEPT_BITS)
            kept[name] = wide - (wide - F.col(name))
        return query(spark, folder).withColumns(kept)

    return rounded


def nine_sql(columns: str, sql: str) -> str:
    """The same for the query's SQL."""
    wide = "({0} * {1!r}::DOUBLE)"
    kept = ", ".join(
        f"{w} - ({w} - {c}) AS {c}" for c in columns.split() if (w := wide.format(c, KEPT_BITS))
    )
    return f"SELECT * REPLACE ({kept}) FROM ({sql})"


def plain(ts: str | Column) -> Column:
    """Zone-less timestamp, as the tables themselves store it."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_transactions(apply_settings(spark), folder)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_transactions(apply_settings(spark), folder)


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lines``, joined once and written to the shared folder, for queries that read them more than once."""
    named = [F.col(f"transaction_id.{c}").alias(c) for c in ("l_orderkey", "l_linenumber")]
    ids = [F.col(c).cast("long").alias(c) for c in ("user_id", "merchant_id")]
    joined = lines(spark, folder).select(*named, *ids, "amount", "event_ts", "is_refund", "is_dispute")
    path = work_folder(spark, "lines")
    joined.write.parquet(path)
    return spark.read.schema(joined.schema).parquet(path).select(
        F.struct("l_orderkey", "l_linenumber", F.col("amount").alias("l_extendedprice")).alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        "amount",
        "event_ts",
        "is_refund",
        "is_dispute",
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(apply_settings(spark), folder, name)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
