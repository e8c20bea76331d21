"""Windowed velocity per user; the same function serves streams and batches."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tidemark.operators.sums import double_sum
from tidemark.sources.folders import read_small, write_small

WATERMARK = "10 seconds"
NEAR_REAL_TIME = "5 minutes"
#: Keeps state on executors' disks; Spark's default holds all open windows in their heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session for stateful queries.

    Their partition count is fixed by the checkpoint at the first start, so choose ``partitions`` for
    the state's expected size; without it the cores present now decide.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    partitions = partitions or max(1, spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return session


def hop_velocity(
    txns: DataFrame, *, width: str = "5 minutes", slide: str = "1 minute", minutes: float = 5.0
) -> DataFrame:
    """Count, sum and events per minute per user and hopping window [start, end)."""
    if txns.isStreaming:
        txns = txns.withWatermark("event_ts", WATERMARK)
    return (
        txns.groupBy("user_id", F.window("event_ts", width, slide).alias("_window"))
        .agg(
            F.count(F.lit(1)).alias("txn_count_5m"),
            double_sum("amount").alias("txn_amount_sum_5m"),
        )
        .select(
            "user_id",
            "txn_count_5m",
            "txn_amount_sum_5m",
            (F.col("txn_count_5m") / F.lit(minutes)).alias("velocity_per_min"),
            F.col("_window.end").alias("window_end"),
        )
    )


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a query on its checkpoint.

    With ``every`` it runs on with that trigger interval (the near-real-time tier uses
    ``NEAR_REAL_TIME``); without, it reads all there is and this call waits for it.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to_folder(
    stream: DataFrame, folder: str, checkpoint: str, *, every: str | None = None
) -> StreamingQuery:
    """Append finished rows to a Parquet folder, each exactly once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", folder)
    return start(writer, checkpoint, every)


class LateRows(StreamingQueryListener):
    """Counts what queries of a session drop as later than the watermark, over their whole life.

    ``session.streams.addListener(LateRows(spark, folder))``; a batch that is run again counts once. Counts are kept in
    ``folder``, one file per query and batch, so a listener made after a restart goes on with them; without one they last
    as long as the listener. The unit is Spark's: rows as they reach the stateful operator, for aggregates one per group
    and batch. (``side_outputs`` counts events instead.)
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None) -> None:
        self._spark, self._folder = spark, folder
        self._dropped: dict[str, dict[int, int]] = {}
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        batches = self._batches(str(progress.id))
        # A trigger without data reports its batch number again.
        if dropped > batches.get(progress.batchId, 0):
            batches[progress.batchId] = dropped
            if self._folder:
                write_small(self._spark, f"{self._folder}/{progress.id}/{progress.batchId}", str(dropped))

    def onQueryTerminated(self, event) -> None:
        self._of(event.runId).set()

    def _of(self, run) -> threading.Event:
        return self._ended.setdefault(str(run), threading.Event())

    def _batches(self, query: str) -> dict[int, int]:
        if query not in self._dropped:
            stored = read_small(self._spark, f"{self._folder}/{query}") if self._folder else {}
            self._dropped[query] = {int(batch): int(text) for batch, text in stored.items()}
        return self._dropped[query]

    def total(self, query: StreamingQuery, patience: float = 60.0) -> int:
        """Rows dropped by all runs of the query that this listener, or an earlier one of its folder, saw.

        Progress is reported in the background: a query that has ended is waited for.
        """
        if not query.isActive and not self._of(query.runId).wait(patience):
            raise TimeoutError("the query's last progress was not reported")
        return sum(self._batches(str(query.id)).values())
