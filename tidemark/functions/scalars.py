"""Scalar feature logic as Columns, shared by batch, streaming and on-demand use."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per duration unit.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def amount_zscore(amount: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; 0 without a positive spread."""
    return F.when(F.coalesce(std, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise((amount - mean) / std)


def chargeback_rate(chargebacks: Column, txns: Column) -> Column:
    return F.when(txns > 0, chargebacks / txns).otherwise(F.lit(0.0))


def log1p_amount(amount: Column) -> Column:
    """log(1 + amount), negatives as 0, null stays null."""
    return F.when(amount.isNotNull(), F.log1p(F.greatest(amount, F.lit(0.0))))


def is_cross_border(user_country: Column, merchant_country: Column) -> Column:
    known = (F.coalesce(user_country, F.lit("")) != "") & (
        F.coalesce(merchant_country, F.lit("")) != ""
    )
    return F.when(known, (user_country != merchant_country).cast("int")).otherwise(F.lit(0))


def velocity(count: Column, window_seconds: Column) -> Column:
    """Events per minute."""
    return F.when(window_seconds <= 0, F.lit(0.0)).otherwise(
        count / (F.nullif(window_seconds, F.lit(0)) / F.lit(60.0))
    )


def ratio_or_zero(amount: Column, base: Column) -> Column:
    """amount / base; 0 when the base is missing or 0, or the amount is missing."""
    return F.coalesce(amount / F.nullif(base, F.lit(0.0)), F.lit(0.0))


def pair_is_first_txn(count: Column) -> Column:
    return (count == 1).cast("int")


def is_within_ttl(feature_ts: Column, event_ts: Column, ttl: timedelta) -> Column:
    """Neither later than the event nor older than ``ttl`` (both ends inclusive)."""
    age = F.unix_micros(event_ts) - F.unix_micros(feature_ts)
    return (age >= 0) & (age <= F.lit(ttl // timedelta(microseconds=1)))


def ensure_utc(ts: Column) -> Column:
    """Timestamps without a zone are UTC (the session zone is pinned to UTC)."""
    return ts.cast("timestamp")


def event_date(ts: Column) -> Column:
    return F.to_date(ensure_utc(ts))


def parse_duration(spec: Column) -> Column:
    """'30s', '5m', '24h', '7d', '2w' to seconds; anything else is an error when evaluated."""
    trimmed = F.trim(spec)
    # Numbers above 12 digits would not fit in seconds.
    unit = F.regexp_extract(trimmed, r"^0*\d{1,12}([smhdw])$", 1)
    seconds = F.lit(None).cast("long")
    for name, length in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(length).cast("long")).otherwise(seconds)
    number = F.regexp_extract(trimmed, r"^0*(\d{1,12})[smhdw]$", 1)
    return F.when(unit != "", F.try_to_number(number, F.lit("9" * 18)).cast("long") * seconds).when(
        spec.isNotNull(), F.raise_error(F.concat(F.lit("invalid duration: "), spec)).cast("long")
    )


def parse_duration_text(spec: str) -> timedelta:
    """The same for a plan-time value."""
    text = spec.strip()
    if not text[:-1].isdigit() or text[-1:] not in UNIT_SECONDS:
        raise ValueError(f"invalid duration: {spec!r}")
    return timedelta(seconds=int(text[:-1]) * UNIT_SECONDS[text[-1]])
