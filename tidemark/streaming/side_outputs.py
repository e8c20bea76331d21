"""Malformed and late messages as outputs of their own, counted from the data.

Each micro-batch is computed once and parted into three: payloads that can't be decoded, events later than the watermark,
and the rest, which goes to the given sink. Outputs are folders per batch that a replayed batch overwrites, and a batch's
counts are one row in a log that also carries the newest event time on. So the totals are the same whatever the sink does,
however often a batch is run, and after a restart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.asof import micros
from tidemark.sources.folders import has_data
from tidemark.sources.streams import decode_or_keep
from tidemark.streaming.velocity import start

_COUNTS = "messages long, malformed long, late long, newest long"


def side_outputs(
    messages: DataFrame,
    checkpoint: str,
    folder: str,
    sink: Callable[[DataFrame, int], None],
    *,
    delay: timedelta = timedelta(seconds=10),
    reach: timedelta = timedelta(0),
    every: str | None = None,
) -> StreamingQuery:
    """Run JSON ``messages(value)`` into ``sink(on_time, batch_id)``, what is malformed or late into ``folder``.

    An event is late if ``event_ts + reach`` is not after the watermark: the newest event time of earlier batches less
    ``delay``. ``reach`` is how long windows stay open for an event. Events without a time are never late.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id > 0 and has_data(spark, f"{folder}/counts/batch={batch_id - 1}"):
            newest = spark.read.schema(_COUNTS).parquet(f"{folder}/counts/batch={batch_id - 1}").first()["newest"]
        at = F.unix_micros("event_ts")
        late = F.lit(False)
        if newest is not None:
            late = F.coalesce(at + micros(reach) <= newest - micros(delay), F.lit(False))
        bad = F.col("malformed").isNotNull()
        decoded = decode_or_keep(batch).withColumn("late", late & ~bad).persist()
        try:
            decoded.where(bad).select("malformed").write.mode("overwrite").parquet(f"{folder}/malformed/batch={batch_id}")
            out = decoded.where("late").drop("malformed", "late")
            out.write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            sink(decoded.where(~bad & ~F.col("late")).drop("malformed", "late"), batch_id)
            counts = decoded.agg(
                F.count(F.lit(1)).alias("messages"),
                F.count("malformed").alias("malformed"),
                F.count_if("late").alias("late"),
                F.greatest(F.max(at), F.lit(newest).cast("long")).alias("newest"),
            )
            # Written last: the next batch begins from it.
            counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        finally:
            decoded.unpersist()

    return start(messages.writeStream.foreachBatch(step), checkpoint, every)


def side_totals(spark: SparkSession, folder: str) -> DataFrame:
    """``(messages, malformed, late)`` over the whole life of a stream's ``folder``."""
    if not has_data(spark, f"{folder}/counts"):
        return spark.createDataFrame([(0, 0, 0)], "messages long, malformed long, late long")
    counts = spark.read.schema(_COUNTS).parquet(f"{folder}/counts")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "malformed", "late")])
