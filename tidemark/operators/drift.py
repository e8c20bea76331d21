"""Distribution drift between a baseline and a current sample: PSI and two-sample KS.

All features go through one pass in long form. PSI bins are the baseline's quantile edges; current
values outside them stay in the denominator only. Nulls and NaN are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantile_sql, running_counts
from tidemark.sources.feature_table import FeatureTable

# Share floor and alert thresholds.
SHARE_FLOOR = 1e-6
PSI_WATCH, PSI_ALERT = 0.1, 0.2
KS_P_VALUE = 0.05
BASELINE_DAYS = 30
KS_TERMS = 100


def long_samples(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, value, base, cur``: every non-null value of the features both frames have."""
    shared = [f for f in features if f in baseline.columns and f in current.columns]
    if not shared:
        raise ValueError("baseline and current share none of the features")

    def melt(df: DataFrame, base: int) -> DataFrame:
        values = df.select(*[F.col(f).cast("double").alias(f) for f in shared])
        return values.unpivot([], shared, "feature", "value").select(
            "feature",
            "value",
            F.lit(base).cast("long").alias("base"),
            F.lit(1 - base).cast("long").alias("cur"),
        )

    both = melt(baseline, 1).unionByName(melt(current, 0))
    return both.where(F.col("value").isNotNull() & ~F.isnan("value"))


def drift_statistics(
    samples: DataFrame, bins: int = 10, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Per feature: sample sizes, ``psi``, ``ks_stat`` and ``ks_pvalue``.

    Sizes, then ranks, then bins: three passes. What the first two find is one row per feature (a
    column of the frames), so it comes to the driver and goes back out as a small table.
    """
    sizes = samples.groupBy("feature").agg(
        F.sum("base").alias("n_base"), F.sum("cur").alias("n_cur")
    )
    sizes = _fixed(sizes)
    shape = _fixed(_shape(samples, sizes, bins, rows_per_slice))
    return shape.join(_psi(samples, shape, bins), "feature", "left").selectExpr(
        "feature",
        "n_base",
        "n_cur",
        "coalesce(psi, 0D) AS psi",
        "ks_stat",
        f"{ks_pvalue('ks_stat', 'n_base', 'n_cur')} AS ks_pvalue",
    )


def _fixed(per_feature: DataFrame) -> DataFrame:
    """The rows, one per feature, computed once."""
    return per_feature.sparkSession.createDataFrame(per_feature.collect(), per_feature.schema)


def _shape(
    samples: DataFrame, sizes: DataFrame, bins: int, rows_per_slice: int | None
) -> DataFrame:
    """KS statistic and the baseline's quantile edges, read off the running counts."""
    ranked = running_counts(
        samples, ["feature"], "value", ["base", "cur"], rows_per_slice=rows_per_slice
    ).join(F.broadcast(sizes), "feature")
    picks, edges = quantile_sql("value", "base", "n_base", range(bins + 1), bins)
    gap = "max(abs(base_upto / nullif(n_base, 0) - cur_upto / nullif(n_cur, 0)))"
    return (
        ranked.groupBy("feature", "n_base", "n_cur")
        .agg(F.expr(f"coalesce({gap}, 0D) AS ks_stat"), *[F.expr(pick) for pick in picks])
        .selectExpr(
            "feature",
            "n_base",
            "n_cur",
            "ks_stat",
            f"array_compact(array_distinct(array({', '.join(edges)}))) AS edges",
        )
    )


def _psi(samples: DataFrame, shape: DataFrame, bins: int) -> DataFrame:
    """PSI per feature: both samples counted into the bins where they are, then the terms summed."""
    placed = samples.join(F.broadcast(shape), "feature").selectExpr(
        "*",
        "size(edges) - 1 AS bins",
        "CASE WHEN value = element_at(edges, -1) THEN size(edges) - 1"
        " ELSE size(filter(edges, e -> e <= value)) END AS bin",
    )
    sums, terms = [], []
    for i in range(1, bins + 1):
        sums += [f"sum(CASE WHEN bin = {i} THEN {c} ELSE 0 END) AS {c}{i}" for c in ("base", "cur")]
        e, a = (f"greatest({c}{i} / n_{c}, {SHARE_FLOOR}D)" for c in ("base", "cur"))
        terms.append(f"CASE WHEN bins >= {i} THEN ({a} - {e}) * ln({a} / {e}) ELSE 0D END")
    usable = "n_base > 0 AND n_cur > 0 AND bins > 0"
    return (
        placed.groupBy("feature", "n_base", "n_cur", "bins")
        .agg(*[F.expr(total) for total in sums])
        .selectExpr(
            "feature", f"CASE WHEN {usable} THEN {' + '.join(terms)} ELSE 0D END AS psi"
        )
    )


def ks_pvalue(stat: str, n_base: str, n_cur: str) -> str:
    """SQL for the asymptotic two-sided p-value (Kolmogorov series); 1 for an empty sample.

    Below 0.3 the scaled statistic's series converges slowly and the value is 1 to many digits.
    """
    scaled = f"{stat} * sqrt({n_base} * {n_cur} / nullif({n_base} + {n_cur}, 0))"
    series = (
        f"aggregate(sequence(1, {KS_TERMS}), 0D, (total, k) -> total"
        f" + if(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * pow({scaled}, 2)))"
    )
    return (
        f"CASE WHEN {n_base} = 0 OR {n_cur} = 0 OR {scaled} < 0.3D THEN 1D"
        f" ELSE least(greatest({series}, 0D), 1D) END"
    )


def drift_report(
    samples: DataFrame, feature_view: str, *, bins: int = 10, rows_per_slice: int | None = None
) -> DataFrame:
    """Statistics with the verdict: alert on PSI or KS, and the PSI band."""
    stats = drift_statistics(samples, bins, rows_per_slice=rows_per_slice)
    psi = F.col("psi")
    band = F.when(psi > PSI_ALERT, "alert").when(psi >= PSI_WATCH, "watch").otherwise("stable")
    return stats.select(
        F.lit(feature_view).alias("feature_view"),
        *stats.columns,
        band.alias("band"),
        ((psi > PSI_ALERT) | (F.col("ks_pvalue") < KS_P_VALUE)).alias("alert"),
    )


def baseline_due(last_refresh: date, today: date, cadence_days: int = BASELINE_DAYS) -> bool:
    return (today - last_refresh).days >= cadence_days


def baseline_and_current(
    rows: DataFrame, today: date, *, ts: str = "event_ts", days: int = BASELINE_DAYS
) -> tuple[DataFrame, DataFrame]:
    """The ``days`` before ``today`` as baseline, and ``today`` itself as the current sample."""
    day = F.to_date(ts)
    start = today - timedelta(days=days)
    return (
        rows.where((day >= F.lit(start)) & (day < F.lit(today))),
        rows.where(day == F.lit(today)),
    )



def stored_baseline(table: FeatureTable, today: date, *, days: int = BASELINE_DAYS) -> tuple[DataFrame, DataFrame]:
    """The same two samples of a stored view, reading only their days' folders."""
    at = [datetime.combine(today + timedelta(days=n), time(), timezone.utc) for n in (-days, 0, 1)]
    return table.read_range(at[0], at[1]), table.read_range(at[1], at[2])
