"""Trailing-window features per event, as running totals over entries and expiries.

A window that slides with every event is two running sums: each event adds at its own time and
subtracts again just after ``ts + width``. That costs one sort however long or crowded the window
is, whereas a RANGE frame re-aggregates every frame. Sums run on decimal limbs (see ``sums``), so
taking values out again is exact, and NaN and infinities leave with their row. Squares are summed
without rounding, so a deviation is right down to some 1e-14 of the mean.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import amount_zscore, velocity
from tidemark.operators.asof import micros
from tidemark.operators.scan import Total, neighbours, ordered_scan
from tidemark.operators.slices import ROWS_PER_SLICE, Slices, plan_slices
from tidemark.operators.sums import FEW, PARTS, SUMMED, joined, with_limbs, with_variance


def plan_window_slices(
    txns: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    *,
    event_ts: str = "event_ts",
    probes: DataFrame | None = None,
    rows_per_slice: int | None = None,
) -> Slices:
    """Slices for rows that enter and leave a trailing window; reads only keys and time.

    Serves every pass over the same rows and keys.
    """
    at, known = _at(event_ts), _known([*keys, event_ts])
    moments = F.explode(F.array(at, at + micros(width) + 1)).alias("_at")
    rows = txns.where(known).select(*keys, moments)
    if probes is not None:
        rows = rows.unionByName(probes.where(known).select(*keys, at.alias("_at")))
    return plan_slices(rows, keys, "_at", 2 * (rows_per_slice or ROWS_PER_SLICE))


def rolling_features(
    txns: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    *,
    event_ts: str = "event_ts",
    amount: str | None = "amount",
    spread: bool = False,
    distinct: Mapping[str, str] | None = None,
    prefix: str = "txn",
    suffix: str = "30d",
    probes: DataFrame | None = None,
    slices: Slices | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add trailing-window features over ``[ts - width, ts]`` to every row, in one scan per key.

    With ``probes`` (same key and time columns) the features go to those rows instead.

    ``amount`` gives count, sum and avg (and sample std with ``spread``); null amounts count as
    events but not in sum or average. ``distinct`` maps columns to the name of their distinct count.
    Rows without key or time get no window.
    """
    keys, distinct = list(keys), dict(distinct or {})
    known = _known([*keys, event_ts])
    if slices is None:
        slices = plan_window_slices(
            txns, keys, width, event_ts=event_ts, probes=probes, rows_per_slice=rows_per_slice
        )
    # Keys of few rows need no decimals: they are slow, and three times as wide in a sort.
    kind = None if slices.largest is not None and slices.largest <= FEW else SUMMED
    deltas: list[str] = []
    valued = txns
    if amount is not None:
        one = {"_n": F.lit(1).cast("long"), "_valued": F.col(amount).isNotNull().cast("long")}
        valued = with_limbs(txns.withColumns(one), amount, "_sum", "_square" if spread else None)
        deltas = [*one, *[f"{x}_{part}" for x in ("_sum", "_square")[: 1 + spread] for part in PARTS]]
    out_rows = txns if probes is None else probes
    if probes is None and deltas:
        rows = _ledger(valued, keys, event_ts, width, deltas, F.struct(*txns.columns))
    else:
        rows = _probes(out_rows, keys, event_ts)
        if deltas:
            ledger = _ledger(valued, keys, event_ts, width, deltas, None)
            rows = rows.unionByName(ledger, allowMissingColumns=True)
    names = list(deltas)
    for i, item in enumerate(distinct):
        marks = txns.where(_known([*keys, item, event_ts])).select(
            *keys, item, _at(event_ts).alias("_at"), F.lit(0).alias("_tie")
        )
        # A key and item can only be heavy together if the key is.
        by_item = Slices((*keys, item))
        if slices.any_heavy:
            by_item = plan_slices(marks, by_item.keys, "_at", rows_per_slice)
        changes = _presence_changes(marks, keys, item, width, f"_d{i}", by_item)
        rows = rows.unionByName(changes, allowMissingColumns=True)
        names.append(f"_d{i}")

    scanned = ordered_scan(
        rows,
        keys,
        "_at",
        [Total(n, f"{n}_run", kind if n.startswith(("_sum_", "_square_")) else None) for n in names],
        peers=True,
        slices=slices,
    )
    rest = out_rows.where(~known).select(F.struct("*").alias("_row"))
    out = scanned.unionByName(rest, allowMissingColumns=True)

    added: dict[str, Column] = {}
    if amount is not None:
        if spread:
            out = with_variance(out, "_var", _sums, _squares, F.col("_valued_run"), kind)
        added |= _total_columns(prefix, suffix, spread)
    for i, name in enumerate(distinct.values()):
        count = F.coalesce(f"_d{i}_run", F.lit(0))
        added[name] = F.when(F.col("_at").isNotNull(), count)
    return out.select("_row.*", *[c.alias(n) for n, c in added.items()])


def _probes(rows: DataFrame, keys: list[str], event_ts: str) -> DataFrame:
    return rows.where(_known([*keys, event_ts])).select(
        *keys,
        _at(event_ts).alias("_at"),
        F.lit(True).alias("_probe"),
        F.struct(*rows.columns).alias("_row"),
    )


def _ledger(
    txns: DataFrame,
    keys: list[str],
    event_ts: str,
    width: timedelta,
    deltas: list[str],
    row: Column | None,
) -> DataFrame:
    """Each row as an entry that adds and an expiry that subtracts, from one read of the input.

    Given ``row``, entries are probes as well and carry it.
    """
    at = _at(event_ts)

    def change(when: Column, is_entry: bool, amounts: list[Column]) -> Column:
        carried = []
        if row is not None:
            carried = [F.when(F.lit(is_entry), row).alias("_row")]
        probe = F.lit(is_entry and row is not None).alias("_probe")
        return F.struct(when.alias("_at"), probe, *carried, *amounts)

    entry = change(at, True, [F.col(n) for n in deltas])
    expiry = change(at + micros(width) + 1, False, [(-F.col(n)).alias(n) for n in deltas])
    return txns.where(_known([*keys, event_ts])).select(*keys, F.inline(F.array(entry, expiry)))


def _presence_changes(
    marks: DataFrame, keys: list[str], item: str, width: timedelta, name: str, slices: Slices
) -> DataFrame:
    """+1 when an item enters a key's trailing window, -1 just after it leaves.

    Events of one item whose windows touch form one span, so no set of items is ever held.
    """
    span, by_item = micros(width), [*keys, item]
    if slices.any_heavy:
        # Slicing needs distinct instants; light groups settle equal instants in the window itself.
        marks = marks.distinct()
    marks = neighbours(marks, by_item, "_at", "_tie", slices=slices)
    begins = F.col("_previous").isNull() | (F.col("_previous") < F.col("_at") - span)
    ends = F.col("_following").isNull() | (F.col("_following") > F.col("_at") + span)
    entered = F.struct(F.col("_at"), F.when(begins, 1).cast("long").alias(name))
    left = F.struct(
        (F.col("_at") + span + 1).alias("_at"), F.when(ends, -1).cast("long").alias(name)
    )
    changes = marks.select(*keys, F.inline(F.array(entered, left)))
    return changes.where(F.col(name).isNotNull()).withColumn("_probe", F.lit(False))


def _sums(part: str) -> Column:
    return F.col(f"_sum_{part}_run")


def _squares(part: str) -> Column:
    return F.col(f"_square_{part}_run")


def _total_columns(prefix: str, suffix: str, spread: bool) -> dict[str, Column]:
    total, valued = joined(_sums), F.col("_valued_run")
    added = {
        f"{prefix}_count_{suffix}": F.coalesce("_n_run", F.lit(0)),
        f"{prefix}_amount_sum_{suffix}": F.when(valued > 0, total),
        f"{prefix}_amount_avg_{suffix}": F.when(valued > 0, total / valued),
    }
    if spread:
        added[f"{prefix}_amount_std_{suffix}"] = F.sqrt("_var")
    return added


def sliding_window(
    events: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    *,
    event_ts: str = "event_ts",
    value: str = "value",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Count, sum and events per minute over the trailing window, for every event."""
    totals = rolling_features(
        events,
        keys,
        width,
        event_ts=event_ts,
        amount=value,
        prefix="window",
        suffix="trailing",
        rows_per_slice=rows_per_slice,
    )
    seconds = F.lit(width.total_seconds())
    return totals.select(
        *events.columns,
        F.col("window_count_trailing").alias("window_count"),
        F.coalesce("window_amount_sum_trailing", F.lit(0.0)).alias("window_sum"),
        velocity(F.col("window_count_trailing"), seconds).alias("velocity_per_min"),
    )


def amount_zscores(
    txns: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    *,
    slices: Slices | None = None,
    rows_per_slice: int | None = None,
    out: str = "amount_zscore_user_30d",
) -> DataFrame:
    """Add each amount's z-score against the trailing window of its key (sample deviation)."""
    totals = rolling_features(
        txns,
        keys,
        width,
        prefix="_z",
        suffix="w",
        spread=True,
        slices=slices,
        rows_per_slice=rows_per_slice,
    )
    score = amount_zscore(F.col("amount"), F.col("_z_amount_avg_w"), F.col("_z_amount_std_w"))
    return totals.select(*txns.columns, score.alias(out))


def seconds_since_previous(
    txns: DataFrame,
    keys: Sequence[str],
    *,
    event_ts: str = "event_ts",
    tie: str = "transaction_id",
    out: str = "seconds_since_prev_txn",
    slices: Slices | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add whole seconds since the key's previous row in (time, tie) order; null for the first."""
    known = _known([*keys, event_ts])
    beside = neighbours(
        txns.where(known).withColumn("_at", _at(event_ts)),
        keys,
        "_at",
        tie,
        slices=slices,
        rows_per_slice=rows_per_slice,
    )
    gap = F.floor((F.col("_at") - F.col("_previous")) / F.lit(1_000_000)).cast("long")
    rest = txns.where(~known).withColumn(out, F.lit(None).cast("long"))
    return beside.select(*txns.columns, gap.alias(out)).unionByName(rest)


def _at(event_ts: str) -> Column:
    return F.unix_micros(F.col(event_ts).cast("timestamp"))


def _known(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
