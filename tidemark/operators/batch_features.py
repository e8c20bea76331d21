"""Batch features as of a date: conditional aggregates over the trailing window [as_of - n, as_of].

Each view is one pass with one shuffle on its key; hash aggregation combines before that shuffle,
so a key with very many transactions costs each reducer one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_id
from tidemark.functions.scalars import chargeback_rate, is_cross_border, pair_is_first_txn
from tidemark.operators.rolling import (
    amount_zscores,
    plan_window_slices,
    rolling_features,
    seconds_since_previous,
)
from tidemark.operators.sums import double_sum
from tidemark.sources.feature_table import instant, with_partition

MONTH, QUARTER = timedelta(days=30), timedelta(days=90)


def until(txns: DataFrame, as_of: datetime, ts: str = "event_ts") -> DataFrame:
    return txns.where(F.col(ts) <= instant(as_of))


def trailing(as_of: datetime, width: timedelta, ts: str = "event_ts") -> Column:
    return F.col(ts).between(instant(as_of - width), instant(as_of))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def stamp(df: DataFrame, as_of: datetime, created: datetime | None) -> DataFrame:
    stamped = df.withColumns(
        {"event_ts": instant(as_of), "created_ts": instant(created or as_of)}
    )
    return with_partition(stamped)


def user_features(
    txns: DataFrame,
    as_of: datetime,
    *,
    countries: DataFrame | None = None,
    created: datetime | None = None,
) -> DataFrame:
    """User features for every user with history: 30-day activity, age, 90-day chargebacks, country.

    ``countries`` is ``user_id, home_country``.
    """
    month, quarter = trailing(as_of, MONTH), trailing(as_of, QUARTER)
    amount = F.when(month, F.col("amount"))
    sums = (
        until(txns, as_of)
        .groupBy("user_id")
        .agg(
            F.datediff(instant(as_of), F.min("event_ts")).cast("long").alias("account_age_days"),
            _count_if(month).alias("txn_count_30d"),
            F.coalesce(double_sum(amount), F.lit(0.0)).alias("txn_amount_sum_30d"),
            F.count(amount).alias("_valued"),
            F.count_distinct(F.when(month, F.col("merchant_id"))).alias("distinct_merchants_30d"),
            chargeback_rate(
                _count_if(quarter & F.col("is_chargeback")), _count_if(quarter)
            ).alias("chargeback_rate_90d"),
        )
    )
    average = F.when(F.col("_valued") > 0, F.col("txn_amount_sum_30d") / F.col("_valued"))
    out = sums.withColumn("txn_amount_avg_30d", average).drop("_valued")
    if countries is not None:
        out = out.join(countries.select("user_id", "home_country"), "user_id", "left")
    return stamp(out.withColumnRenamed("user_id", "entity_id"), as_of, created)


def user_peaks(
    txns: DataFrame, as_of: datetime, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Per user, the highest 30-day count, sum, average and distinct merchants ever reached."""
    both = rolling_features(
        until(txns, as_of),
        ["user_id"],
        MONTH,
        distinct={"merchant_id": "distinct_merchants_30d"},
        rows_per_slice=rows_per_slice,
    )
    names = ("txn_count_30d", "txn_amount_sum_30d", "txn_amount_avg_30d", "distinct_merchants_30d")
    return both.groupBy(F.col("user_id").alias("entity_id")).agg(*[F.max(n).alias(n) for n in names])


def pair_features(txns: DataFrame, as_of: datetime, *, created: datetime | None = None) -> DataFrame:
    """User by merchant, 90 days: count, sum, last amount, whether it is the only transaction."""
    out = (
        txns.where(trailing(as_of, QUARTER))
        .groupBy("user_id", "merchant_id")
        .agg(
            F.count(F.lit(1)).alias("pair_txn_count_90d"),
            double_sum("amount").alias("pair_amount_sum_90d"),
            F.max_by("amount", F.struct("event_ts", "transaction_id")).alias("pair_last_amount"),
        )
        .withColumn(
            "pair_is_first_txn", pair_is_first_txn(F.col("pair_txn_count_90d")).cast("long")
        )
    )
    encoded = entity_id({"user_id": F.col("user_id"), "merchant_id": F.col("merchant_id")})
    out = out.withColumn("entity_id", encoded).drop("user_id", "merchant_id")
    return stamp(out, as_of, created)


def merchant_features(
    txns: DataFrame, as_of: datetime, *, created: datetime | None = None
) -> DataFrame:
    """Merchant age, average ticket, 30-day refund rate and 90-day dispute rate."""
    month, quarter = trailing(as_of, MONTH), trailing(as_of, QUARTER)
    out = (
        until(txns, as_of)
        .groupBy(F.col("merchant_id").alias("entity_id"))
        .agg(
            F.datediff(instant(as_of), F.min("event_ts")).cast("long").alias("merchant_age_days"),
            (double_sum("amount") / F.nullif(F.count("amount"), F.lit(0))).alias("avg_ticket_size"),
            chargeback_rate(_count_if(month & F.col("is_refund")), _count_if(month)).alias(
                "refund_rate_30d"
            ),
            chargeback_rate(_count_if(quarter & F.col("is_dispute")), _count_if(quarter)).alias(
                "dispute_rate_90d"
            ),
        )
    )
    return stamp(out, as_of, created)


def with_countries(txns: DataFrame, users: DataFrame, merchants: DataFrame) -> DataFrame:
    """Add ``user_country`` and ``merchant_country`` by dimension lookup.

    ``users`` and ``merchants`` hold one row per id, so the joins never multiply rows; adaptive
    execution broadcasts a dimension that is measured small and splits hot ids otherwise.
    """
    return txns.join(users.select("user_id", "user_country"), "user_id", "left").join(
        merchants.select("merchant_id", "merchant_country"), "merchant_id", "left"
    )


def transaction_features(txns: DataFrame, *, rows_per_slice: int | None = None) -> DataFrame:
    """Per transaction: amount, 30-day z-score, seconds since the user's previous one, cross-border."""
    slices = plan_window_slices(txns, ["user_id"], MONTH, rows_per_slice=rows_per_slice)
    scored = amount_zscores(txns, ["user_id"], MONTH, slices=slices)
    gaps = seconds_since_previous(scored, ["user_id"], slices=slices)
    return gaps.select(
        F.col("transaction_id").cast("string").alias("entity_id"),
        "event_ts",
        "amount",
        "amount_zscore_user_30d",
        "seconds_since_prev_txn",
        is_cross_border(F.col("user_country"), F.col("merchant_country"))
        .cast("long")
        .alias("is_cross_border"),
    )


def user_activity_by_day(
    txns: DataFrame, days: Sequence[date], *, rows_per_slice: int | None = None
) -> DataFrame:
    """30-day user activity at midnight of each of ``days``, in one job for all of them.

    Only transactions that some day can see are read. Every user among them is probed once per day;
    the window is [day - 30 d, day], and users without a transaction in it are left out.
    """
    moments = F.array(*[instant(_midnight(d)) for d in sorted(set(days))])
    first, last = _midnight(min(days)), _midnight(max(days))
    seen = txns.where(F.col("event_ts").between(instant(first - MONTH), instant(last)))
    users = seen.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    activity = rolling_features(
        seen.select("user_id", "merchant_id", "amount", "event_ts"),
        ["user_id"],
        MONTH,
        distinct={"merchant_id": "distinct_merchants_30d"},
        probes=users.select("user_id", F.explode(moments).alias("event_ts")),
        rows_per_slice=rows_per_slice,
    )
    active = activity.where("txn_count_30d > 0").withColumnRenamed("user_id", "entity_id")
    total = F.coalesce("txn_amount_sum_30d", F.lit(0.0))
    return active.withColumn("txn_amount_sum_30d", total)


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)
