"""Reports over lists of stored views, from what their writes noted per day: no rows are read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.health import NULL_RATE_LIMIT, freshness
from tidemark.sources.feature_table import FeatureTable


def _stats(tables: Sequence[FeatureTable], start: date | None = None, end: date | None = None) -> DataFrame:
    """The day statistics of all views, one row per view and day."""
    each = [t.day_stats(start, end).withColumn("feature_view", F.lit(t.name)) for t in tables]
    return reduce(DataFrame.unionByName, each)


def stored_freshness(tables: Sequence[FeatureTable], slas: DataFrame, now: datetime) -> DataFrame:
    """Age of every view in ``slas`` (``feature_view, sla``) against its limit; a view without rows is infinitely old."""
    newest = _stats(tables).groupBy("feature_view").agg(F.max("latest_event_ts").alias("latest_event_ts"))
    return freshness(newest, slas, now)


def stored_null_rates(
    tables: Sequence[FeatureTable],
    start: date | None = None,
    end: date | None = None,
    *,
    threshold: float = NULL_RATE_LIMIT,
) -> DataFrame:
    """``(feature_view, feature, null_rate, breached)`` over the days from start to end; nothing for a view without rows."""
    stats = _stats(tables, start, end).select("feature_view", "rows", F.explode("nulls").alias("feature", "nulls"))
    rate = stats.groupBy("feature_view", "feature").agg((F.sum("nulls") / F.sum("rows")).alias("null_rate"))
    return rate.withColumn("breached", F.col("null_rate") > threshold)


def stored_volumes(tables: Sequence[FeatureTable], start: date | None = None, end: date | None = None) -> DataFrame:
    """``(feature_view, event_date, rows)`` per stored day."""
    return _stats(tables, start, end).select("feature_view", "event_date", "rows")
