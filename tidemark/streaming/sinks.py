"""Dual writes of windowed features: the latest table now, the offline table for training."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.feature_table import FeatureTable, newest_version
from tidemark.sources.latest_table import LatestTable
from tidemark.streaming.velocity import start

VELOCITY_FEATURES = "txn_count_5m long, txn_amount_sum_5m double, velocity_per_min double"
VELOCITY_TTL = timedelta(seconds=600)
SINK_TTL = timedelta(seconds=3600)


def as_feature_rows(windows: DataFrame, key: str = "user_id") -> DataFrame:
    """Window rows as feature rows: the window's end is the event time."""
    return windows.withColumnsRenamed({key: "entity_id", "window_end": "event_ts"})


def upsert_online(
    batch: DataFrame,
    online: LatestTable,
    *,
    ttl: timedelta,
    written: Column | None = None,
    token: str | None = None,
) -> None:
    """Newest window per entity into the latest table; an older window never replaces a newer one.

    A batch that the table remembers by its ``token`` is not written again.
    """
    moment = F.current_timestamp() if written is None else written
    stamped = batch.withColumn("_written", moment)
    newest = newest_version(stamped, ["entity_id"], ["event_ts"])
    online.write(newest, F.col("_written"), ttl, newest_wins=True, token=token)


def snapshot_offline(
    batch: DataFrame, offline: FeatureTable, *, created: Column | None = None
) -> None:
    """All rows of the batch into the offline table, stamped with their write time."""
    moment = F.current_timestamp() if created is None else created
    offline.upsert(batch.withColumn("created_ts", moment))


def dual_write(
    stream: DataFrame,
    checkpoint: str,
    *,
    online: LatestTable,
    offline: FeatureTable | None = None,
    ttl: timedelta = SINK_TTL,
    written: Column | None = None,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run a feature stream (``entity_id, event_ts, <features>``) into both tables.

    Both writes are upserts, so a batch replayed after a failure leaves the same rows behind. A micro-batch is computed
    once, for both tables. ``written`` replaces the clock as write time (it may use the row's columns).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            upsert_online(batch, online, ttl=ttl, written=written, token=f"{checkpoint}:{batch_id}")
            if offline is not None:
                snapshot_offline(batch, offline, created=written)
        finally:
            batch.unpersist()

    return start(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, every)
