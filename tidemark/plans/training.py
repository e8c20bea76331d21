"""Training sets: views attached to a spine as of each row's time, and a manifest of what went in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_id
from tidemark.operators.asof import AsOfView, point_in_time_join_views
from tidemark.plans.views import SERVICES, VIEWS, FeatureView
from tidemark.sources.feature_table import FeatureTable, time_bounds
from tidemark.sources.folders import has_data


@dataclass(frozen=True)
class TrainingSet:
    """The joined rows, the spine they came from (as many rows) and each view's version."""

    rows: DataFrame
    spine: DataFrame
    versions: dict[str, int]


def _require(spine: DataFrame, views: Mapping[str, Iterable[str]], event_ts: str, label: str | None) -> None:
    """One error that names every column the spine lacks, and for what."""
    needs = {f"keys of {name}": keys for name, keys in views.items()} | {"row time": [event_ts]}
    if label is not None:
        needs["label"] = [label]
    lacks = {why: sorted(set(c) - set(spine.columns)) for why, c in needs.items()}
    found = [f"{', '.join(c)} ({why})" for why, c in lacks.items() if c]
    if found or not views:
        raise ValueError(f"no views asked for, or spine columns absent: {'; '.join(found) or 'no views'}")


def build_training_set(
    spine: DataFrame,
    views: Iterable[AsOfView],
    *,
    event_ts: str = "event_ts",
    label: str | None = None,
    versions: Mapping[str, int] | None = None,
    rows_per_slice: int | None = None,
) -> TrainingSet:
    """Attach the views to the spine as of each row's time; a view without a version counts as 1."""
    views = list(views)
    _require(spine, {v.name: v.keys for v in views}, event_ts, label)
    rows = point_in_time_join_views(spine, views, event_ts=event_ts, rows_per_slice=rows_per_slice)
    return TrainingSet(rows, spine, {v.name: (versions or {}).get(v.name, 1) for v in views})


def build_from_tables(
    spine: DataFrame,
    tables: Mapping[str, FeatureTable],
    views: Mapping[str, FeatureView],
    *,
    event_ts: str = "event_ts",
    label: str | None = None,
    known_at: datetime | None = None,
) -> TrainingSet:
    """The same from stored tables, each on its own view's key columns.

    Tables hold encoded ids; the spine's key columns are encoded alike, once per set of keys. Each scan
    covers [first row - ttl, last row] and no more. With ``known_at`` versions written later are not
    seen, so that a set can be made again (for tables that keep their versions).
    """
    _require(spine, {n: v.keys for n, v in views.items()}, event_ts, label)
    bounds = time_bounds(spine, event_ts)
    if bounds is None:
        raise ValueError("the spine has no row with an event time")
    encoded = {v.keys: "_id_" + "_".join(v.keys) for v in views.values()}
    with_ids = spine.withColumns(
        {name: entity_id({k: F.col(k).cast("string") for k in keys}) for keys, name in encoded.items()}
    )
    inputs = []
    for name, view in views.items():
        found = tables[name].view_for(*bounds, view.ttl, known_at=known_at)
        frame = found.frame.withColumnRenamed("entity_id", encoded[view.keys])
        inputs.append(
            AsOfView(name, frame, (encoded[view.keys],), ttl=view.ttl, columns=found.columns)
        )
    rows = point_in_time_join_views(with_ids, inputs, event_ts=event_ts).drop(*encoded.values())
    return TrainingSet(rows, spine, {n: v.version for n, v in views.items()})


def service_training_set(
    spine: DataFrame, service: str, tables: Mapping[str, FeatureTable], **options
) -> TrainingSet:
    """All views of a named service from their tables; options as for ``build_from_tables``."""
    if service not in SERVICES:
        raise LookupError(f"{service!r} is none of the services {sorted(SERVICES)}")
    return build_from_tables(spine, tables, {n: VIEWS[n] for n in SERVICES[service]}, **options)


def manifest(training: TrainingSet, *, service: str, snapshot: str) -> DataFrame:
    """One row per view: ``view:vN``, the service, the snapshot label and the set's row count.

    The set has the spine's rows, so only those are counted.
    """
    pinned = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature_view"), F.lit(v).alias("version"))
                for n, v in sorted(training.versions.items())
            ]
        )
    )
    size = training.spine.agg(F.count(F.lit(1)).alias("row_count"))
    return size.select("row_count", pinned.alias("_view")).select(
        "_view.*",
        F.concat(F.col("_view.feature_view"), F.lit(":v"), F.col("_view.version")).alias("pinned"),
        F.lit(service).alias("service"),
        F.lit(snapshot).alias("snapshot_id"),
        "row_count",
    )


def save_training_set(training: TrainingSet, folder: str, *, service: str, snapshot: str) -> str:
    """Write the set and, last, its manifest beside it; the path of the set.

    A snapshot is written once: if its manifest exists, nothing is computed. One without a manifest
    was cut short and is written again.
    """
    spark = training.rows.sparkSession
    root = f"{folder.rstrip('/')}/{service}/{snapshot}"
    if not has_data(spark, f"{root}/manifest"):
        training.rows.write.mode("overwrite").parquet(f"{root}/rows")
        made = manifest(training, service=service, snapshot=snapshot)
        made.write.mode("overwrite").parquet(f"{root}/manifest")
    return f"{root}/rows"
