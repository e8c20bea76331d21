"""Feature views and services as plan-time metadata."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from tidemark.functions.scalars import parse_duration_text


@dataclass(frozen=True)
class FeatureView:
    name: str
    keys: tuple[str, ...]
    features: str  # DDL of the feature columns
    ttl: timedelta
    sensitivity: str = "public"
    tier: str = "batch"
    sla_freshness: str = "24h"
    version: int = 1
    source_contract: str | None = None

    @property
    def sla(self) -> timedelta:
        return parse_duration_text(self.sla_freshness)


# The declared views.
USER_FEATURES = FeatureView(
    "user_features_v2",
    ("user_id",),
    "account_age_days long, txn_count_30d long, txn_amount_sum_30d double,"
    " txn_amount_avg_30d double, distinct_merchants_30d long, chargeback_rate_90d double,"
    " home_country string",
    timedelta(days=90),
    sensitivity="financial",
    version=2,
    source_contract="warehouse.users.v3",
)
MERCHANT_FEATURES = FeatureView(
    "merchant_features_v1",
    ("merchant_id",),
    "merchant_age_days long, avg_ticket_size double, refund_rate_30d double,"
    " dispute_rate_90d double",
    timedelta(days=180),
    sensitivity="financial",
    source_contract="warehouse.merchants.v2",
)
TRANSACTION_FEATURES = FeatureView(
    "transaction_features_v1",
    ("transaction_id",),
    "amount double, amount_zscore_user_30d double, seconds_since_prev_txn long,"
    " is_cross_border long",
    timedelta(days=30),
    sensitivity="financial",
    tier="near-real-time",
    sla_freshness="5m",
    source_contract="warehouse.transactions.v4",
)
PAIR_FEATURES = FeatureView(
    "user_merchant_features_v1",
    ("user_id", "merchant_id"),
    "pair_txn_count_90d long, pair_amount_sum_90d double, pair_last_amount double,"
    " pair_is_first_txn long",
    timedelta(days=90),
    sensitivity="financial",
    source_contract="warehouse.transactions.v4",
)
VIEWS = {
    v.name: v for v in (USER_FEATURES, MERCHANT_FEATURES, TRANSACTION_FEATURES, PAIR_FEATURES)
}

# The views each service bundles.
SERVICES = {
    "fraud_scoring_v3": (
        "user_features_v2",
        "merchant_features_v1",
        "transaction_features_v1",
        "user_merchant_features_v1",
    ),
    "underwriting_v1": ("user_features_v2", "merchant_features_v1"),
}
