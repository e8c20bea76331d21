"""Ordered state per key: the one primitive under as-of joins, rolling features and ranks.

Input rows carry a key, an order value and some fold inputs; rows flagged ``_probe`` come out again
with each fold's state at their order value. Light keys take one shuffle and one window pass. Heavy
keys (see ``slices``) are grouped by ``(key, slice)``; what happened before a slice enters it as one
extra row holding the folded state at its cut, so the window inside a slice needs nothing else.

Rows exactly on a cut are folded into that carried state. Probes on an instant so crowded that
several cuts fell on it take the carried state by a map-side join and never shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.slices import Slices, plan_slices


@dataclass(frozen=True)
class Last:
    """Newest non-null value; equal order values are settled by the value's own order."""

    column: str
    out: str

    def running(self, window: WindowSpec) -> Column:
        return F.last(self.column, ignorenulls=True).over(window)

    def partial(self, at: str) -> Column:
        return F.max(F.when(F.col(self.column).isNotNull(), F.struct(at, self.column)))

    def carried(self, window: WindowSpec) -> Column:
        return F.last(self.column, ignorenulls=True).over(window)[self.column]


@dataclass(frozen=True)
class Total:
    """Running sum, of another type than the column's if ``kind`` names one."""

    column: str
    out: str
    kind: str | None = None

    def running(self, window: WindowSpec) -> Column:
        return self._sum().over(window)

    def partial(self, at: str) -> Column:
        return self._sum()

    def _sum(self) -> Column:
        return F.sum(F.col(self.column).cast(self.kind) if self.kind else F.col(self.column))

    def carried(self, window: WindowSpec) -> Column:
        return F.sum(self.column).over(window)


Fold = Last | Total


def ordered_scan(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    folds: Sequence[Fold],
    *,
    peers: bool,
    slices: Slices | None = None,
    rows_per_slice: int | None = None,
    lane: str | None = None,
) -> DataFrame:
    """State of every fold at each ``_probe`` row, rows with the same order value included.

    With ``peers`` a row may be both probe and input (running totals). Without, probes come after
    the inputs of the same instant and ties among inputs go to the greatest input value. Rows need
    non-null keys and order value.

    ``lane`` names a column that is 0 for such rows. Rows without key or order value may then come
    along in other lanes, spread by a hash: they meet no input and come out with empty states.
    """
    keys = list(keys)
    lanes = [lane] if lane else []
    if slices is None:
        slices = plan_slices(rows, keys, at, rows_per_slice)
    inputs = [f.column for f in folds]

    def frame(*partition: str) -> WindowSpec:
        window = Window.partitionBy(*partition)
        if peers:
            return window.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        window = window.orderBy(at, "_probe", *inputs)
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def finish(df: DataFrame, window: WindowSpec) -> DataFrame:
        return (
            df.withColumns({f.out: f.running(window) for f in folds})
            .where("_probe")
            .drop("_probe", *lanes, *inputs)
        )

    if not slices.any_heavy:
        return finish(rows, frame(*keys, *lanes))

    tagged = slices.tag(rows, at)
    carried = _state_at_cuts(rows, keys, at, folds, slices)
    on_cut = F.coalesce(F.col("_upto") > F.col("_below"), F.lit(False))
    crowded = F.coalesce(F.col("_upto") - F.col("_below") > 1, F.lit(False)) & F.col("_probe")
    sliced = tagged.withColumn("_slice", F.coalesce("_upto", F.lit(0)))

    inside = sliced.where(~crowded & (F.col("_probe") | ~on_cut)).withColumns(
        {name: F.when(~on_cut, F.col(name)) for name in inputs}
    )
    seeds = carried.select(
        *keys,
        "_slice",
        F.col("_cut").alias(at),
        F.lit(False).alias("_probe"),
        *[F.lit(0).cast("long").alias(x) for x in lanes],
        *inputs,
    )
    stepped = finish(
        inside.drop("_below", "_upto").unionByName(seeds, allowMissingColumns=True),
        frame(*keys, *lanes, "_slice"),
    )
    if not slices.crowded:
        return stepped.drop("_slice")
    states = carried.select(*keys, "_slice", *[F.col(f.column).alias(f.out) for f in folds])
    pinned = (
        sliced.where(crowded)
        .drop("_below", "_upto", "_probe", *lanes, *inputs)
        .join(F.broadcast(states), [*keys, "_slice"], "left")
    )
    return stepped.unionByName(pinned).drop("_slice")


def _state_at_cuts(
    rows: DataFrame, keys: list[str], at: str, folds: Sequence[Fold], slices: Slices
) -> DataFrame:
    """Folded state at every cut, rows on the cut included: keys, ``_slice``, ``_cut``, inputs."""
    inputs = [f.column for f in folds]
    given = reduce(Column.__or__, [F.col(c).isNotNull() for c in inputs])
    segments = (
        slices.tag(rows.select(*keys, at, *inputs).where(given), at, heavy_only=True)
        .groupBy(*keys, "_below")
        .agg(*[f.partial(at).alias(f.column) for f in folds])
        .withColumn("_slice", F.col("_below") + 1)
        .drop("_below")
    )
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        slices.grid()
        .join(segments, [*keys, "_slice"], "left")
        .withColumns(
            {
                **{f.column: f.carried(so_far) for f in folds},
                "_next_cut": F.lead("_cut").over(by_key),
            }
        )
        .where(F.col("_next_cut").isNull() | (F.col("_next_cut") > F.col("_cut")))
        .drop("_next_cut")
    )


def neighbours(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    *,
    slices: Slices | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add ``_previous`` and ``_following``: the order values next to each row in its key.

    Order is ``(at, tie, hash of the row)``, whether a key is split or not; rows equal in all columns
    are interchangeable. ``tie`` may be null or repeated.
    """
    keys = list(keys)
    if slices is None:
        slices = plan_slices(rows, keys, at, rows_per_slice)
    order = F.struct(F.col(tie).alias("tie"), F.xxhash64(*rows.columns).alias("hash"))
    rows = rows.withColumn("_order", order)

    def beside(df: DataFrame, *partition: str) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(at, "_order")
        return df.withColumns(
            {"_previous": F.lag(at).over(window), "_following": F.lead(at).over(window)}
        )

    if not slices.any_heavy:
        return beside(rows, *keys).drop("_order")

    tagged = slices.tag(rows, at)
    crowded = F.coalesce(F.col("_upto") - F.col("_below") > 1, F.lit(False))
    # Rows on a crowded instant form a slice of their own, placed before the rows that follow it.
    sliced = tagged.withColumns(
        {
            "_slice": F.coalesce(F.col("_upto") * 2 - F.when(crowded, 1).otherwise(0), F.lit(0)),
            "_crowded": crowded,
            "_heavy": F.col("_upto").isNotNull(),
        }
    ).drop("_below", "_upto")
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    edges = (
        sliced.where("_heavy")
        .groupBy(*keys, "_slice")
        .agg(
            F.min(at).alias("_low"),
            F.max(at).alias("_high"),
            F.min("_order").alias("_first"),
            F.max("_order").alias("_final"),
        )
        .select(
            *keys,
            "_slice",
            "_first",
            "_final",
            F.lag("_high").over(by_key).alias("_before"),
            F.lead("_low").over(by_key).alias("_after"),
        )
    )
    joined = sliced.join(F.broadcast(edges), [*keys, "_slice"], "left")
    stepped = beside(joined.where(~F.col("_crowded")), *keys, "_slice").withColumns(
        {
            "_previous": F.coalesce("_previous", "_before"),
            "_following": F.coalesce("_following", "_after"),
        }
    )
    scratch = (
        "_order", "_slice", "_crowded", "_heavy", "_first", "_final", "_before", "_after"
    )
    if not slices.crowded:
        return stepped.drop(*scratch)
    # Of a crowded instant only the first and the last row look beyond it. Rows equal to them in all
    # columns are told apart by number; no others are shuffled.
    at_edge = F.col("_order").eqNullSafe(F.col("_first")) | F.col("_order").eqNullSafe(F.col("_final"))
    alike = Window.partitionBy(*keys, "_slice", "_order")
    nth = F.row_number().over(alike.orderBy(at))
    first = F.col("_order").eqNullSafe(F.col("_first")) & (F.col("_nth") == 1)
    final = F.col("_order").eqNullSafe(F.col("_final")) & (F.col("_nth") == F.col("_alike"))
    pinned = joined.where("_crowded")
    inner = pinned.where(~at_edge).withColumns({"_previous": F.col(at), "_following": F.col(at)})
    outer = (
        pinned.where(at_edge)
        .withColumns({"_nth": nth, "_alike": F.count(F.lit(1)).over(alike)})
        .withColumns(
            {
                "_previous": F.when(first, F.col("_before")).otherwise(F.col(at)),
                "_following": F.when(final, F.col("_after")).otherwise(F.col(at)),
            }
        )
        .drop("_nth", "_alike")
    )
    return stepped.unionByName(inner).unionByName(outer).drop(*scratch)
