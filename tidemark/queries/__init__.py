"""The registered queries: one per operator, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from tidemark.queries import batch, governance, monitoring, streams, tables, training
from tidemark.queries.common import nine, nine_sql

# Columns that hold sums of doubles, per query; both sides keep nine digits of them.
_MONTH = "txn_amount_sum_30d txn_amount_avg_30d"
SUMS = {
    "rolling_30d": _MONTH,
    "rolling_30d_scaled": _MONTH,
    "user_features_asof": _MONTH,
    "user_features_scaled": _MONTH,
    "user_features_tiles": _MONTH,
    "user_peak_30d": _MONTH,
    "training_set": _MONTH,
    "rolling_30d_special": "txn_amount_sum_30d",
    "merchant_sums_special": "avg_ticket_size",
    "pair_features": "pair_amount_sum_90d",
    "merchant_features": "avg_ticket_size",
    "sliding_window": "window_sum",
    "sliding_window_scaled": "window_sum",
    "sliding_state_keyed": "window_sum",
    "hop_velocity_stream": "txn_amount_sum_5m",
    "hop_velocity_batch": "txn_amount_sum_5m",
    "hop_velocity_scaled": "txn_amount_sum_5m",
    "hop_velocity_tumbling": "txn_amount_sum_5m",
    "baseline": "amount_sum",
    "baseline_stored": "amount_sum",
}
MODULES = (training, batch, tables, monitoring, governance, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
QUERIES |= {name: nine(columns, QUERIES[name]) for name, columns in SUMS.items()}
ORACLES |= {name: nine_sql(columns, ORACLES[name]) for name, columns in SUMS.items()}
