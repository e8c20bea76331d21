"""Resumable recomputation of past days, many days per Spark job."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.feature_table import PARTITION, FeatureTable, instant, partition_days
from tidemark.sources.folders import has_data

RUNS = (
    "run_id string, feature_view string, start_date date, end_date date, status string,"
    " rows_written long, requested_by string, created_at timestamp, updated_at timestamp"
)
PARTITIONS = (
    "run_id string, feature_view string, partition_date date, status string,"
    " rows_written long, completed_at timestamp"
)


class BackfillLog:
    """Append-only run and partition records; the newest record of a run is its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not has_data(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def runs(self) -> DataFrame:
        return self._read("backfill_runs", RUNS)

    def partitions(self) -> DataFrame:
        return self._read("backfill_partitions", PARTITIONS)

    def record_run(self, **values) -> None:
        row = self.spark.range(1).select(
            *[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in self.runs().schema]
        )
        row.write.mode("append").parquet(f"{self.root}/backfill_runs")

    def record_partitions(self, rows: DataFrame) -> None:
        rows.select(*self.partitions().columns).write.mode("append").parquet(
            f"{self.root}/backfill_partitions"
        )


def pending_days(days: DataFrame, partitions: DataFrame, feature_view: str) -> DataFrame:
    """Requested days not yet completed for the view, in any run that finished them."""
    done = partitions.where(
        (F.col("feature_view") == feature_view) & (F.col("status") == "completed")
    )
    return days.join(done.select("partition_date").distinct(), "partition_date", "left_anti")


def run_rollup(runs: DataFrame, partitions: DataFrame) -> DataFrame:
    """State of every run: newest status, completed partitions and rows."""
    newest = runs.groupBy("run_id", "feature_view").agg(
        F.max_by("status", F.struct("updated_at", "status")).alias("status")
    )
    done = (
        partitions.where(F.col("status") == "completed")
        .groupBy("run_id")
        .agg(
            F.count_distinct("partition_date").alias("partitions_done"),
            F.sum("rows_written").alias("rows_written"),
        )
    )
    return newest.join(done, "run_id", "left").select(
        "run_id",
        "feature_view",
        "status",
        F.coalesce("partitions_done", F.lit(0)).alias("partitions_done"),
        F.coalesce("rows_written", F.lit(0)).alias("rows_written"),
    )


def run_backfill(
    log: BackfillLog,
    table: FeatureTable,
    start: date,
    end: date,
    compute: Callable[[list[date]], DataFrame],
    *,
    requested_by: str,
    now: datetime,
    dry_run: bool = False,
    days_per_job: int = 30,
) -> str:
    """Compute and write every pending day of [start, end]; returns the run id.

    ``compute`` takes a list of days and returns their feature rows; it is called once per
    ``days_per_job`` pending days, not once per day. Days are recorded after their
    write, so a failed run resumes after the last finished job. Each day's folder is replaced.
    """
    spark, run_id = log.spark, uuid.uuid4().hex[:12]
    state = {
        "run_id": run_id,
        "feature_view": table.name,
        "start_date": start,
        "end_date": end,
        "rows_written": 0,
        "requested_by": requested_by,
        "created_at": instant(now),
        "updated_at": instant(now),
    }
    log.record_run(**state, status="pending" if dry_run else "running")
    if dry_run:
        return run_id
    todo = pending_days(partition_days(spark, start, end), log.partitions(), table.name)
    days = [r[0] for r in todo.orderBy("partition_date").collect()]  # calendar days only
    total = 0
    try:
        for i in range(0, len(days), days_per_job):
            chunk = days[i : i + days_per_job]
            table.replace_days(compute(chunk), chunk)
            wanted = spark.createDataFrame([(d,) for d in chunk], "partition_date date")
            counts = table.partition_counts().where(F.col(PARTITION).isin(*chunk))
            done = wanted.join(counts, F.col("partition_date") == F.col(PARTITION), "left").select(
                F.lit(run_id).alias("run_id"),
                F.lit(table.name).alias("feature_view"),
                "partition_date",
                F.lit("completed").alias("status"),
                F.coalesce("rows", F.lit(0)).cast("long").alias("rows_written"),
                instant(now).alias("completed_at"),
            )
            written = done.agg(F.sum("rows_written")).first()[0]
            log.record_partitions(done)
            total += written
    except Exception:
        log.record_run(**_later(state, now, total), status="failed")
        raise
    log.record_run(**_later(state, now, total), status="completed")
    return run_id


def _later(state: dict, now: datetime, rows: int) -> dict:
    return {**state, "rows_written": rows, "updated_at": instant(now + timedelta(microseconds=1))}
