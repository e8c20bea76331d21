"""Copying recent offline values into the latest table, behind the data-quality gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.quality import Expectation, require_quality
from tidemark.plans.views import FeatureView
from tidemark.sources.feature_table import FeatureTable, latest_per_entity
from tidemark.sources.latest_table import LatestTable


def materialize_view(
    source: FeatureTable,
    target: LatestTable,
    start: datetime,
    end: datetime,
    *,
    now: datetime,
    ttl: timedelta,
    gate: Sequence[Expectation] = (),
    fail_fraction: float = 0.0,
) -> DataFrame:
    """Write the newest row per entity of [start, end); returns ``feature_view, rows_written``.

    The count is that of this window, taken from the write itself; an empty window writes nothing.
    """
    window = source.read_range(start, end)
    if gate:
        require_quality(window, gate, fail_fraction=fail_fraction)
    count = 0
    if not window.isEmpty():
        seen = Observation()
        newest = latest_per_entity(window).observe(seen, F.count(F.lit(1)).alias("rows"))
        target.write(newest, now, ttl)
        count = seen.get["rows"]
    schema = "feature_view string, rows_written long"
    return target.spark.createDataFrame([(target.name, count)], schema)


def materialize_views(
    sources: Mapping[str, FeatureTable],
    targets: Mapping[str, LatestTable],
    views: Mapping[str, FeatureView],
    start: datetime,
    end: datetime,
    *,
    now: datetime,
    ttl: timedelta | None = None,
) -> DataFrame:
    """Materialize each view with its own time-to-live (``ttl`` overrides); one count row per view."""
    counts = None
    for name, source in sources.items():
        done = materialize_view(
            source, targets[name], start, end, now=now, ttl=ttl or views[name].ttl
        )
        counts = done if counts is None else counts.unionByName(done)
    return counts
