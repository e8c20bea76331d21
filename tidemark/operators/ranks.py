"""Exact ranks and quantiles without holding a group's values anywhere.

Values are combined to counts per distinct value first, so copies collapse before the shuffle; the
running counts then come from the ordered scan, which splits crowded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import Total, ordered_scan
from tidemark.operators.slices import plan_slices


def running_counts(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Sequence[str],
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Per key and distinct value: the summed weights and, as ``<weight>_upto``, their running sums."""
    keys = list(keys)
    slices = plan_slices(values, keys, value, rows_per_slice)
    counted = values.groupBy(*keys, value).agg(*[F.sum(w).alias(w) for w in weights])
    rows = counted.withColumns(
        {"_probe": F.lit(True), **{f"_{w}": F.col(w) for w in weights}}
    )
    folds = [Total(f"_{w}", f"{w}_upto") for w in weights]
    return ordered_scan(rows, keys, value, folds, peers=True, slices=slices)


def quantile_sql(
    value: str, weight: str, size: str, positions: Sequence[int], parts: int
) -> tuple[list[str], list[str]]:
    """SQL that picks quantiles position/parts out of ``running_counts`` rows.

    First the aggregates (``_low<p>``, ``_high<p>``: the values at the two ranks around the
    quantile), then per position the interpolation of the two. Ranks are integers throughout, so a
    quantile that falls on a value is that value.
    """
    picks, combined = [], []
    for p in positions:
        scaled = f"({p} * ({size} - 1))"
        low, share = f"{scaled} div {parts}", f"{scaled} % {parts}"
        high = f"{low} + CAST({share} > 0 AS INT)"
        for name, rank in (("low", low), ("high", high)):
            picks.append(
                f"max(CASE WHEN {weight}_upto - {weight} <= {rank} AND {rank} < {weight}_upto"
                f" THEN {value} END) AS _{name}{p}"
            )
        combined.append(f"_low{p} + (_high{p} - _low{p}) * ({share} / {float(parts)}D)")
    return picks, combined


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Sequence[int],
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per key as ``p<n>``, with the group's ``rows``."""
    keys = list(keys)
    usable = df.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("long").alias("_w"))
    ranked = running_counts(usable, keys, value, ["_w"], rows_per_slice=rows_per_slice)
    sizes = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    picks, combined = quantile_sql(value, "_w", "rows", percents, 100)
    return (
        ranked.join(sizes, keys)
        .groupBy(*keys, "rows")
        .agg(*[F.expr(pick) for pick in picks])
        .selectExpr(
            *keys, "rows", *[f"{q} AS p{p}" for p, q in zip(percents, combined, strict=True)]
        )
    )
