"""Per-event trailing windows on a stream.

State is the stretch of recent rows that later windows can still reach, kept as a table beside the
checkpoint, one version per micro-batch. Each micro-batch is joined with it and goes through the
same operator as a batch, so a user with very many events is split there instead of filling one
state-store key. Output and state of a batch are overwritten when it is replayed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.asof import micros
from tidemark.operators.rolling import sliding_window
from tidemark.sources.folders import drop_folder, has_data
from tidemark.streaming.velocity import start


def sliding_stream(
    stream: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    folder: str,
    checkpoint: str,
    *,
    value: str = "amount",
    event_ts: str = "event_ts",
    delay: timedelta = timedelta(seconds=10),
    every: str | None = None,
    rows_per_slice: int | None = None,
) -> StreamingQuery:
    """Append count, sum and velocity per event to ``folder``; too late events are left out.

    An event later than ``delay`` behind the newest one of earlier batches is dropped. Events
    without a time come out without a window, in every batch.
    """
    columns, at = stream.columns, F.unix_micros(event_ts)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        recent = f"{checkpoint}/recent/{batch_id - 1}"
        fresh = batch.withColumn("_fresh", F.lit(True))
        rows = fresh
        if batch_id > 0 and has_data(spark, recent):
            kept = spark.read.parquet(recent)
            newest = kept.agg(F.max(at)).first()[0]
            if newest is not None:
                fresh = fresh.where(at.isNull() | (at >= newest - micros(delay)))
            rows = kept.withColumn("_fresh", F.lit(False)).unionByName(fresh)
        rows = rows.persist()
        counted = sliding_window(
            rows, keys, width, event_ts=event_ts, value=value, rows_per_slice=rows_per_slice
        )
        counted.where("_fresh").drop("_fresh").write.mode("overwrite").parquet(
            f"{folder}/batch={batch_id}"
        )
        end = rows.agg(F.max(at)).first()[0]
        # A batch of events without times leaves the state as it was.
        reach = at.isNotNull() & (at >= F.coalesce(F.lit(end).cast("long"), F.lit(0)) - micros(width + delay))
        rows.where(reach).select(*columns).write.mode("overwrite").parquet(f"{checkpoint}/recent/{batch_id}")
        rows.unpersist()
        drop_folder(spark, f"{checkpoint}/recent/{batch_id - 2}")

    return start(stream.writeStream.foreachBatch(step), f"{checkpoint}/query", every)
