"""Monitoring reports: null rates, freshness, online/offline skew, latency, alerts, usage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import parse_duration
from tidemark.operators.asof import RESERVED
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.sums import double_sum
from tidemark.sources.feature_table import instant

# Thresholds and the guard against a zero mean.
NULL_RATE_LIMIT = 0.05
SKEW_LIMIT = 0.1
SKEW_EPSILON = 1e-9
LATENCY_LIMIT_SECONDS = 0.010
#: Where findings go unless the caller says otherwise: severity to channel.
CHANNELS = {"page": "on-call", "ticket": "tracker", "slack": "chat"}


def null_rates(
    df: DataFrame, threshold: float = NULL_RATE_LIMIT, skip: Sequence[str] = RESERVED
) -> DataFrame:
    """Null (or NaN) share of every feature column in one pass; nothing for an empty frame."""
    features = [f for f in df.schema if f.name not in skip]

    def rate(field: T.StructField) -> Column:
        missing = F.col(field.name).isNull()
        if isinstance(field.dataType, T.FloatType | T.DoubleType):
            missing = missing | F.isnan(field.name)
        return F.avg(missing.cast("int")).alias(field.name)

    rates = df.agg(*[rate(f) for f in features])
    long = rates.unpivot([], [f.name for f in features], "feature", "null_rate")
    return long.where(F.col("null_rate").isNotNull()).select(
        "feature", "null_rate", (F.col("null_rate") > threshold).alias("breached")
    )


def freshness(newest: DataFrame, slas: DataFrame, now: datetime) -> DataFrame:
    """Age of every view in ``slas`` (``feature_view, sla`` as duration text) against its limit.

    ``newest`` is ``feature_view, latest_event_ts``. A view without data is infinitely old.
    """
    age = (F.unix_micros(instant(now)) - F.unix_micros("latest_event_ts")) / F.lit(1e6)
    aged = slas.join(newest, "feature_view", "left").select(
        "feature_view",
        F.coalesce(age, F.lit(float("inf"))).alias("age_seconds"),
        parse_duration(F.col("sla")).cast("double").alias("sla_seconds"),
    )
    return aged.withColumn("breached", F.col("age_seconds") > F.col("sla_seconds"))


def paired(
    online: DataFrame, offline: DataFrame, features: Sequence[str], key: str = "entity_id"
) -> DataFrame:
    """Both stores' values side by side; ``side`` says matched, online_only or offline_only."""
    on = online.select(
        key, F.lit(True).alias("_on"), *[F.col(f).alias(f"{f}__online") for f in features]
    )
    off = offline.select(
        key, F.lit(True).alias("_off"), *[F.col(f).alias(f"{f}__offline") for f in features]
    )
    side = (
        F.when(F.col("_off").isNull(), "online_only")
        .when(F.col("_on").isNull(), "offline_only")
        .otherwise("matched")
    )
    return on.join(off, key, "full_outer").withColumn("side", side).drop("_on", "_off")


def skew_report(pairs: DataFrame, features: Sequence[str], limit: float = SKEW_LIMIT) -> DataFrame:
    """Per feature: mean |online - offline| / (|mean offline| + eps) over entities both stores have."""
    matched = F.col("side") == "matched"
    aggregates = []
    for f in features:
        a, b = F.col(f"{f}__online").cast("double"), F.col(f"{f}__offline").cast("double")
        usable = matched & a.isNotNull() & b.isNotNull()
        n = F.count(F.when(usable, 1))
        per_row = F.nullif(n, F.lit(0))
        gap = double_sum(F.when(usable, F.abs(a - b))) / per_row
        mean = double_sum(F.when(usable, b)) / per_row
        skew = F.coalesce(gap / (F.abs(mean) + F.lit(SKEW_EPSILON)), F.lit(0.0))
        aggregates.append(
            F.struct(F.lit(f).alias("feature"), skew.alias("skew"), n.alias("n_compared")).alias(f)
        )
    counts = pairs.agg(
        F.count(F.when(F.col("side") == "online_only", 1)).alias("online_only"),
        F.count(F.when(F.col("side") == "offline_only", 1)).alias("offline_only"),
        *aggregates,
    )
    rows = counts.select(
        "online_only", "offline_only", F.explode(F.array(*[F.col(f) for f in features])).alias("_s")
    )
    return rows.select("_s.*", "online_only", "offline_only").withColumn(
        "alert", F.col("skew") > limit
    )


def latency_p99(
    reads: DataFrame,
    *,
    ts: str = "event_ts",
    seconds: str = "latency_seconds",
    limit: float = LATENCY_LIMIT_SECONDS,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """99th percentile read latency per view and five minutes."""
    windowed = reads.select(
        "feature_view", F.window(ts, "5 minutes")["start"].alias("window_start"), seconds
    )
    p99 = exact_quantiles(
        windowed, ["feature_view", "window_start"], seconds, [99], rows_per_slice=rows_per_slice
    )
    return p99.select(
        "feature_view",
        "window_start",
        F.col("rows").alias("reads"),
        F.col("p99").alias("p99_seconds"),
        (F.col("p99") > limit).alias("breached"),
    )


def rows_per_minute(writes: DataFrame, *, ts: str = "written_ts", rows: str = "rows") -> DataFrame:
    minute = F.window(ts, "1 minute")["start"].alias("window_start")
    return writes.groupBy("feature_view", minute).agg(F.sum(rows).alias("rows"))


def hot_entities(reads: DataFrame, k: int) -> DataFrame:
    """The k most read entities per view (ties by entity id), as a mergeable top-k.

    Counts are combined first. Ranking then runs in two steps, per hash part and over the parts'
    winners, so that a view with very many entities is not sorted in one task.
    """
    counts = reads.groupBy("feature_view", "entity_id").agg(F.count(F.lit(1)).alias("reads"))
    parts = F.pmod(F.xxhash64("entity_id"), F.lit(256))
    best = top_k(counts.withColumn("_part", parts), ["feature_view", "_part"], k).drop("_part")
    return top_k(best, ["feature_view"], k)


def top_k(counts: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("reads"), "entity_id")
    return (
        counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    )


def low_usage_views(
    views: DataFrame, reads: DataFrame, now: datetime, days: int = 90
) -> DataFrame:
    """Views nobody read in the last ``days``, with their last read before that."""
    used = reads.groupBy("feature_view").agg(F.max("event_ts").alias("last_read"))
    cutoff = instant(now - timedelta(days=days))
    joined = views.join(used, "feature_view", "left")
    return joined.where(F.col("last_read").isNull() | (F.col("last_read") < cutoff))


def route_alerts(
    spark: SparkSession, *reports: DataFrame, channels: Mapping[str, str] = CHANNELS
) -> DataFrame:
    """Union of findings (``feature_view, title, severity, detail``) with their channel."""
    channels = spark.createDataFrame(list(channels.items()), "severity string, channel string")
    found = reduce(DataFrame.unionByName, reports)
    return found.join(F.broadcast(channels), "severity").select(
        "feature_view", "title", "severity", "detail", "channel"
    )


def _finding(view: Column, title: str, severity: Column, detail: Column) -> list[Column]:
    return [
        view.alias("feature_view"),
        F.lit(title).alias("title"),
        severity.alias("severity"),
        detail.alias("detail"),
    ]


def drift_findings(report: DataFrame) -> DataFrame:
    """PSI alerts become tickets, the watch band goes to chat."""
    severity = F.when(F.col("band") == "alert", "ticket").when(F.col("band") == "watch", "slack")
    return report.where(F.col("band") != "stable").select(
        *_finding(F.col("feature_view"), "psi drift", severity, F.col("feature"))
    )


def freshness_findings(report: DataFrame) -> DataFrame:
    return report.where("breached").select(
        *_finding(F.col("feature_view"), "stale", F.lit("page"), F.lit("older than its limit"))
    )


def skew_findings(report: DataFrame, feature_view: str) -> DataFrame:
    return report.where("alert").select(
        *_finding(F.lit(feature_view), "serving skew", F.lit("ticket"), F.col("feature"))
    )


def latency_findings(report: DataFrame) -> DataFrame:
    breached = report.where("breached").groupBy("feature_view").agg(F.max("p99_seconds"))
    return breached.select(
        *_finding(F.col("feature_view"), "slow reads", F.lit("page"), F.lit("p99 above limit"))
    )
