"""Streaming sources: JSON transactions from Kafka, and Parquet folders."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import EVENT_PROPS, SCHEMAS

TRANSACTION = (
    "transaction_id string, user_id string, merchant_id string, amount double, event_ts timestamp"
)


def decode_transactions(df: DataFrame, value: str | Column = "value") -> DataFrame:
    """Typed transaction columns from a JSON payload."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(F.from_json(column.cast("string"), TRANSACTION).alias("_t")).select("_t.*")


def decode_or_keep(df: DataFrame, value: str | Column = "value") -> DataFrame:
    """The transaction columns, the time a message came (``timestamp``, if the source has it) and, for a payload that is
    no such JSON, the payload itself as ``malformed``; it is null for good ones."""
    column = (F.col(value) if isinstance(value, str) else value).cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    typed = F.from_json(column, f"{TRANSACTION}, malformed string", options)
    # A payload that is null or empty gives no struct, or one without a reason.
    blank = column.isNull() | (F.trim(column) == "")
    return df.select(typed.alias("_t"), F.when(blank, F.coalesce(column, F.lit(""))).alias("_blank")).select(
        *[F.col(f"_t.{name.split()[0]}") for name in TRANSACTION.split(", ")],
        F.coalesce("_t.malformed", "_blank").alias("malformed"),
    )


def kafka_options(
    servers: str,
    topic: str = "transactions",
    *,
    group: str | None = None,
    starting_offsets: str | Mapping[str, Mapping[int, int]] = "latest",
    max_offsets: int | None = None,
) -> dict[str, str]:
    """Reader options. ``starting_offsets`` may give offsets per topic and partition (-2 earliest, -1 latest).

    ``group`` is the consumer group whose rights and quotas hold. Offsets are the checkpoint's affair all the same: two
    queries must not share a group while they run.
    """
    if isinstance(starting_offsets, Mapping):
        offsets = {t: {str(p): int(at) for p, at in parts.items()} for t, parts in starting_offsets.items()}
        if any(at < -2 for parts in offsets.values() for at in parts.values()):
            raise ValueError("offsets are -2, -1 or places in a partition")
        starting = json.dumps(offsets, sort_keys=True)
    elif starting_offsets in ("latest", "earliest"):
        starting = starting_offsets
    else:
        raise ValueError("starting_offsets must be 'latest', 'earliest' or offsets per topic and partition")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "kafka.isolation.level": "read_committed",
    }
    if group:
        options["kafka.group.id"] = group
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def kafka_transactions(spark: SparkSession, servers: str, topic: str = "transactions", **options) -> DataFrame:
    """The transaction topic, committed messages only. The query's checkpoint holds the offsets."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options))
    return decode_transactions(reader.load())


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table file as a stream, with its declared schema."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(folder)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``sources.tables.event_transactions`` as a stream."""
    props = F.from_json("props", EVENT_PROPS)
    return parquet_stream(spark, folder, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        props["k"].cast("string").alias("merchant_id"),
        F.col("value").alias("amount"),
        F.col("ts").alias("event_ts"),
    )
