"""Point-in-time (as-of) joins: the newest feature row at or before each spine row.

All views that share key columns are resolved together: spine and features are unioned, shuffled
once on the key and read off one window. Output has exactly the spine's rows. A match older than
the view's time-to-live (age > ttl) is treated as missing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scan import Last, ordered_scan
from tidemark.operators.slices import ROWS_PER_SLICE, Slices, plan_slices

RESERVED = ("entity_id", "event_ts", "created_ts", "event_date")


@dataclass(frozen=True)
class AsOfView:
    """Feature rows to look up: where they are, what identifies them, how long they stay valid.

    ``rows_per_key`` is a bound on any key's rows, if the table's statistics give one; planning then need not count them.
    """

    name: str
    frame: DataFrame
    keys: tuple[str, ...] = ("entity_id",)
    feature_ts: str = "event_ts"
    created_ts: str | None = "created_ts"
    ttl: timedelta | None = None
    columns: tuple[str, ...] | None = None
    rows_per_key: int | None = None

    def feature_columns(self) -> list[str]:
        if self.columns is not None:
            return list(self.columns)
        skip = {*RESERVED, *self.keys, self.feature_ts, self.created_ts}
        return [c for c in self.frame.columns if c not in skip]


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def point_in_time_join(
    spine: DataFrame,
    features: DataFrame,
    *,
    keys: Sequence[str] = ("entity_id",),
    event_ts: str = "event_ts",
    feature_ts: str = "event_ts",
    created_ts: str | None = "created_ts",
    ttl: timedelta | None = None,
    matched_ts: str | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """As-of join with one feature frame; ``matched_ts`` keeps the matched feature time."""
    view = AsOfView(
        "features",
        features,
        tuple(keys),
        feature_ts,
        created_ts if created_ts in features.columns else None,
        ttl,
    )
    return point_in_time_join_views(
        spine,
        [view],
        event_ts=event_ts,
        matched_ts={view.name: matched_ts} if matched_ts else None,
        rows_per_slice=rows_per_slice,
    )


def point_in_time_join_views(
    spine: DataFrame,
    views: Sequence[AsOfView],
    *,
    event_ts: str = "event_ts",
    matched_ts: dict[str, str] | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """As-of join with many views: one pass per distinct set of key columns."""
    by_keys: dict[tuple[str, ...], list[AsOfView]] = {}
    for view in views:
        by_keys.setdefault(view.keys, []).append(view)
    names = output_names(spine, views)
    out = spine
    for keys, group in by_keys.items():
        # Joining adds columns but no rows, so every group is planned on the spine as given.
        slices = _plan(spine, keys, group, event_ts, rows_per_slice)
        out = _join_group(out, list(keys), group, event_ts, names, matched_ts or {}, slices)
    ordered = [names[v.name][c] for v in views for c in v.feature_columns()]
    kept = [name for name in (matched_ts or {}).values()]
    return out.select(*spine.columns, *ordered, *kept)


def output_names(spine: DataFrame, views: Sequence[AsOfView]) -> dict[str, dict[str, str]]:
    """Feature name per view; a name the spine or another view also has becomes view__feature."""
    # Spark tells columns apart without regard to case.
    uses = Counter(c.lower() for c in spine.columns)
    uses.update(c.lower() for v in views for c in v.feature_columns())
    return {
        v.name: {c: c if uses[c.lower()] == 1 else f"{v.name}__{c}" for c in v.feature_columns()}
        for v in views
    }


def _key_ids(keys: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def _known(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _entries(column: Column, kind: T.DataType) -> Column:
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def _keyed(df: DataFrame, keys: Sequence[str], ts: str, *columns: Column) -> DataFrame:
    """Rows with key and time, under the names the scan uses."""
    return df.where(_known([*keys, ts])).select(
        *[F.col(k).alias(i) for k, i in zip(keys, _key_ids(keys), strict=True)],
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"),
        *columns,
    )


def _plan(
    spine: DataFrame,
    keys: Sequence[str],
    views: Sequence[AsOfView],
    event_ts: str,
    rows_per_slice: int | None,
) -> Slices:
    ids = _key_ids(keys)
    probes = _keyed(spine, keys, event_ts)
    bounds = [v.rows_per_key for v in views]
    if None not in bounds:
        # Where the views have bounds, counting the spine is enough to see that no key can be heavy.
        most = probes.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most + sum(bounds) <= (rows_per_slice or ROWS_PER_SLICE):
            return Slices(tuple(ids))
    moments = [probes] + [_keyed(v.frame, v.keys, v.feature_ts) for v in views]
    return plan_slices(reduce(DataFrame.unionByName, moments), ids, "_at", rows_per_slice)


def _join_group(
    spine: DataFrame,
    keys: list[str],
    views: list[AsOfView],
    event_ts: str,
    names: dict[str, dict[str, str]],
    matched_ts: dict[str, str],
    slices: Slices,
) -> DataFrame:
    # Rows without key or time match nothing. They come along in lanes of their own, so that the
    # spine, which may hold another group's join, is read once.
    usable = _known([*keys, event_ts])
    # Maps have neither hash nor order; the lane needs only what spreads rows.
    hashed = [f.name for f in spine.schema if not _has_map(f.dataType)] or [F.lit(0)]
    lane = F.when(usable, F.lit(0).cast("long")).otherwise(F.xxhash64(*hashed).bitwiseOR(F.lit(1)))
    rows, folds = (
        spine.select(
            *[F.col(k).alias(i) for k, i in zip(keys, _key_ids(keys), strict=True)],
            F.unix_micros(F.col(event_ts).cast("timestamp")).alias("_at"),
            lane.alias("_lane"),
            F.lit(True).alias("_probe"),
            F.struct(*spine.columns).alias("_row"),
        ),
        [],
    )
    for n, view in enumerate(views):
        created = F.col(view.created_ts) if view.created_ts else F.lit(None)
        at = F.unix_micros(F.col(view.feature_ts).cast("timestamp"))
        # Field order settles ties at one instant: newest write first, then the feature values. Maps can't be compared:
        # they go along as sorted entries.
        kinds = {c: view.frame.schema[c].dataType for c in view.feature_columns()}
        features = [_entries(F.col(c), kinds[c]).alias(c) for c in kinds]
        packed = F.struct(
            created.cast("timestamp").alias("_created"),
            at.alias("_feature_at"),
            *features,
        )
        updates = _keyed(
            view.frame,
            view.keys,
            view.feature_ts,
            F.lit(0).cast("long").alias("_lane"),
            F.lit(False).alias("_probe"),
            packed.alias(f"_in{n}"),
        )
        rows = rows.unionByName(updates, allowMissingColumns=True)
        folds.append(Last(f"_in{n}", f"_hit{n}"))

    matched = ordered_scan(
        rows, _key_ids(keys), "_at", folds, peers=False, slices=slices, lane="_lane"
    )
    hits = []
    for n, view in enumerate(views):
        hit = F.col(f"_hit{n}")
        fresh = F.lit(True)
        if view.ttl is not None:
            fresh = F.col("_at") - hit["_feature_at"] <= F.lit(micros(view.ttl))
        for c in view.feature_columns():
            kind = view.frame.schema[c].dataType
            value = F.map_from_entries(hit[c]) if isinstance(kind, T.MapType) else hit[c]
            hits.append(F.when(fresh, value).alias(names[view.name][c]))
        if view.name in matched_ts:
            found = F.timestamp_micros(hit["_feature_at"])
            hits.append(F.when(fresh, found).alias(matched_ts[view.name]))
    return matched.select("_row.*", *hits)


def leakage_audit(joined: DataFrame, *, event_ts: str, matched_ts: str) -> DataFrame:
    """Counts of rows, matches and leaks (a match later than its row; must be zero)."""
    leak = F.col(matched_ts) > F.col(event_ts)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(matched_ts).alias("matched"),
        F.coalesce(F.sum(leak.cast("long")), F.lit(0)).alias("leaks"),
    )
