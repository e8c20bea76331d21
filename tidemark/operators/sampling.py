"""Checking a large join on a sample first: deterministic sampling and fan-out estimate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(
    spine: DataFrame,
    fraction: float = 0.01,
    seed: int = 42,
    by: Sequence[str] = ("entity_id", "event_ts"),
) -> DataFrame:
    """Keep each row with the given probability, decided by a hash of ``by`` and the seed.

    The same rows come out whatever the partitioning or cluster. Timestamps hash as epoch micros.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    parts = []
    for name in by:
        column = F.col(name)
        if spine.schema[name].dataType.typeName() == "timestamp":
            column = F.unix_micros(column)
        parts.append(F.coalesce(column.cast("string"), F.lit("")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return spine.where(draw < F.lit(int(fraction * 2**32)))


def join_fanout(spine: DataFrame, features: DataFrame, key: str = "entity_id") -> DataFrame:
    """Feature rows per distinct spine entity; 0 for an empty spine. Counted before joining."""
    entities = spine.select(key).where(F.col(key).isNotNull()).distinct()
    sizes = features.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    matched = entities.join(sizes, key, "left")
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    return matched.agg(
        F.count(F.lit(1)).alias("entities"),
        rows.alias("feature_rows"),
        F.coalesce(rows / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("fanout"),
    )
